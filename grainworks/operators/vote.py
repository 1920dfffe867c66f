"""Column typing by vote: one aggregate decides all columns, then each column gets one expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainworks.functions import cells

TYPES = ("Integer", "Float", "Boolean", "Date")
#: (column name, counts) -> (guess, confidence)
Resolver = Callable[[str, "Votes"], tuple[str, float]]


@dataclass
class Votes:
    """How many non-blank values of a column pass each test; ``fit`` counts what a column of that type would convert."""

    total: int
    Integer: int
    Float: int
    Boolean: int
    Date: int
    real: int = 0
    samples: list[str] | None = None


_BITS = {"total": cells.SOME, "Integer": cells.INT, "Float": cells.NUMBER, "Boolean": cells.BOOL, "Date": cells.DATE, "real": cells.REAL}


def tallies(name: str) -> list[Column]:
    """The counts of one column of codes, as aggregate expressions."""
    return [F.count_if(cells.has(F.col(name), bit)).alias(f"{name}_{k}") for k, bit in _BITS.items()]


def counted(df: DataFrame, names: list[str]):
    """The row of tallies of raw text columns, with their number of rows as ``n``: one job."""
    codes = cells.coded(df, {n: F.col(n) for n in names})
    return codes.agg(F.count("*").alias("n"), *[c for n in names for c in tallies(n)]).first()


def votes(row, name: str) -> Votes:
    return Votes(row[f"{name}_total"], *[row[f"{name}_{k}"] for k in (*TYPES, "real")])


def rules(column: str, v: Votes) -> tuple[str, float]:
    """The default resolver: more than nine tenths of the non-blank values decide, in a fixed order of types."""
    if not v.total:
        return "Text", 0.0
    for kind in TYPES:
        if 10 * getattr(v, kind) > 9 * v.total:
            return kind, getattr(v, kind) / v.total
    return "Text", 1.0 - max(getattr(v, k) for k in TYPES) / v.total


def is_ambiguous(guess: str, confidence: float, v: Votes) -> bool:
    """Under a confidence of 0.7; for the rules in whole numbers, so that the boundary is exact."""
    if guess == "Text" and v.total and abs(confidence - (1 - max(getattr(v, k) for k in TYPES) / v.total)) < 1e-9:
        return 10 * max(getattr(v, k) for k in TYPES) > 3 * v.total
    return confidence < 0.7


#: what a value of a column that was voted so may become; anything else stays text
_KINDS = {"Integer": cells.INT, "Float": cells.REAL, "Boolean": cells.BOOL}


def typed(t: Column, bits: Column, v: Votes, guess: str, ambiguous: bool) -> Column:
    """A trimmed column and its codes as a plain column where the counts prove that every value has one kind, else as cells."""
    some = bits > 0
    if ambiguous:
        return cells.of_code(t, bits)
    if guess in ("Text", "Date"):
        return F.when(some, t)
    if guess == "Integer" and v.Integer == v.total:
        return F.when(some, t.try_cast("bigint"))
    if guess == "Float" and v.real == v.total:
        return F.when(some, cells.as_float(t))
    if guess == "Boolean" and v.Boolean == v.total:
        return F.when(some, cells.is_true(t))
    return cells.of_code(t, bits, _KINDS[guess])


def simple(v: Votes, guess: str, ambiguous: bool) -> bool:
    """Whether a column's values need no code: blank or not is all that differs."""
    return not ambiguous and (guess in ("Text", "Date") or (guess == "Integer" and v.Integer == v.total) or (guess == "Float" and v.real == v.total) or (guess == "Boolean" and v.Boolean == v.total))


def type_columns(raw: DataFrame, headers: list[str], counts, report, resolver: Resolver = rules) -> DataFrame:
    """``raw``: ``_row`` and text columns c0, ...; ``counts``: the row of tallies."""
    names = [f"c{i}" for i in range(len(headers))]
    samples = _samples(raw.select("_row", *[cells.trimmed(F.col(c)).alias(c) for c in names]), names) if resolver is not rules else {}
    plan = {}
    for c, header in zip(names, headers):
        v = votes(counts, c)
        v.samples = samples.get(c)
        guess, confidence = resolver(header, v)
        unsure = is_ambiguous(guess, confidence, v)
        if unsure:
            report.info(f"column '{header}': the values do not agree on a type (nearest: {guess}, {confidence:.2f}), so each one is typed by itself")
        plan[c] = (v, guess, unsure)
    if all(simple(*plan[c]) for c in names):
        trimmed = raw.select("_row", F.transform(F.array(*names), cells.trimmed).alias("_t"))
        some = lambda t: F.when(t != "", 1).otherwise(0)
        return trimmed.select("_row", *[typed(t, some(t), *plan[c]).alias(c) for i, c in enumerate(names) for t in [F.get("_t", F.lit(i))]])
    codes = cells.coded(raw, {c: F.col(c) for c in names}, ["_row"])
    return codes.select("_row", *[typed(F.col(f"{c}_t"), F.col(c), *plan[c]).alias(c) for c in names])


def _samples(trimmed: DataFrame, names: list[str], n: int = 20) -> dict[str, list[str]]:
    """The first ``n`` values by row of every column, in one job: each is a minimum over the ranks of a column's values."""
    long = trimmed.select("_row", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in names])).alias("x")).select("_row", "x.*").where("v <> ''")
    ranked = long.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("_row"))).where(f"k <= {n}")
    out: dict[str, list[str]] = {c: [] for c in names}
    for r in ranked.orderBy("c", "k").select("c", "v").collect():  # n rows a column; the window keeps no more than n of each while it sorts
        out[r["c"]].append(r["v"])
    return out


def http_resolver(url: str, api_key: str, model: str, timeout: float = 10.0) -> Resolver:
    """A resolver that asks an OpenAI-compatible endpoint about at most 20 samples; any failure is (Text, 0.0)."""
    import json
    import urllib.request

    def ask(column: str, v: Votes) -> tuple[str, float]:
        try:
            prompt = f'Column "{column}" has these values: {json.dumps((v.samples or [])[:20])}. Answer with JSON {{"type": "Integer|Float|Boolean|Date|Text", "confidence": 0..1}} only.'
            body = json.dumps({"model": model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}).encode()
            request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                text = json.load(answer)["choices"][0]["message"]["content"]
            said = json.loads(text[text.index("{") : text.rindex("}") + 1])
            kind = {k.lower(): k for k in (*TYPES, "Text")}[str(said["type"]).lower()]
            return kind, min(1.0, max(0.0, float(said["confidence"])))
        except Exception:  # noqa: BLE001  an unreachable or odd endpoint must not stop cleaning
            return "Text", 0.0

    return ask
