"""One query for each group of operators, with the same result in SQL.

The driver's tables are clean, so a query first renders mess from them with plain arithmetic, in the same way in both
dialects, and then applies the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainworks.functions import cells, sniff
from grainworks.operators import shape, validate, vote
from grainworks.plans import sinks
from grainworks.plans.model import Table
from grainworks.sources.pdf import JUMP

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- cells and votes ----------------------------------------------------------------------------------------------

_CASES = ["''", "concat('00', k)", "concat('  ', k, ' ')", "concat(k, '.5')", "'yes'", "'No'", "'-007'", "'+42'", "'9999999999999999999'", "'1e3'", "'1d'", "concat('R-', k)", "'-9223372036854775808'", "'.25'", "'5.'", "'12-31-2024'", "'TRUE'", "'-0.5'"]
_MESS = "CASE n % {} ".format(len(_CASES)) + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CASES)) + " END"
_CELL_SQL = """
  CASE WHEN t = '' THEN NULL
    WHEN NOT regexp_matches(t, '^-?0[0-9]') AND regexp_full_match(t, '[+-]?[0-9]+') AND TRY_CAST(t AS BIGINT) IS NOT NULL THEN 'int'
    WHEN NOT regexp_matches(t, '^-?0[0-9]') AND NOT regexp_full_match(t, '-?[0-9]+') AND regexp_full_match(t, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'float'
    WHEN lower(t) IN ('true', 'yes', 'false', 'no') THEN 'bool' ELSE 'text' END"""


def _mess(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_orderkey * 3 + l_linenumber").alias("n"), F.col("l_orderkey").cast("string").alias("k")).withColumn("raw", F.expr(_MESS))


_MESS_SQL = f"SELECT l_orderkey, l_linenumber, {_MESS} AS raw FROM (SELECT *, l_orderkey * 3 + l_linenumber AS n, CAST(l_orderkey AS VARCHAR) AS k FROM lineitem)"


@query(f"""
WITH m AS ({_MESS_SQL}), t AS (SELECT *, trim(raw) AS t FROM m), c AS (SELECT *, {_CELL_SQL} AS k FROM t)
SELECT l_orderkey, l_linenumber, k, CASE WHEN k = 'int' THEN TRY_CAST(t AS BIGINT) END AS i, CASE WHEN k = 'float' THEN TRY_CAST(t AS DOUBLE) END AS f,
  CASE WHEN k = 'bool' THEN lower(t) IN ('true', 'yes') END AS b, CASE WHEN k = 'text' THEN t END AS s FROM c""")
def cell_infer(spark, d):
    c = F.col("c")
    return cells.inferred(_mess(spark, d), {"c": F.col("raw")}, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", *[c[x].alias(x) for x in "kifbs"])


_COLUMNS = {
    "key": "CAST(o_orderkey AS STRING)",
    "padded": "CASE WHEN o_orderkey % 5 = 0 THEN concat('0', CAST(o_orderkey AS STRING)) ELSE CAST(o_orderkey AS STRING) END",
    "price": "CASE WHEN o_orderkey % 20 = 0 THEN 'N/A' ELSE concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.5') END",
    "mixed": "CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END",
    "flag": "CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END",
    "day": "concat('2024-01-', CAST(10 + o_orderkey % 20 AS STRING))",
    "state": "o_orderstatus",
    "blank": "''",
}
_STACK = " UNION ALL ".join(f"SELECT '{c}' AS col, o_orderkey, {e.replace('STRING', 'VARCHAR')} AS v FROM orders" for c, e in _COLUMNS.items())
_INT = "NOT regexp_matches(t, '^-?0[0-9]') AND regexp_full_match(t, '[+-]?[0-9]+') AND TRY_CAST(t AS BIGINT) IS NOT NULL"
_FLOAT = "NOT regexp_matches(t, '^-?0[0-9]') AND regexp_full_match(t, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')"
_BOOL = "lower(t) IN ('true', 'yes', 'false', 'no')"
_DATE = "regexp_full_match(t, '[0-9./-]{6,10}') AND length(regexp_replace(t, '[0-9]', '', 'g')) >= 2"
_VOTE = f"""v AS (SELECT col, count(*) FILTER (t <> '') AS total, count(*) FILTER (t <> '' AND {_INT}) AS n_int, count(*) FILTER (t <> '' AND {_FLOAT}) AS n_float,
  count(*) FILTER (t <> '' AND {_BOOL}) AS n_bool, count(*) FILTER (t <> '' AND {_DATE}) AS n_date FROM s GROUP BY col),
g AS (SELECT *, CASE WHEN total = 0 THEN 'Text' WHEN 10 * n_int > 9 * total THEN 'Integer' WHEN 10 * n_float > 9 * total THEN 'Float' WHEN 10 * n_bool > 9 * total THEN 'Boolean'
  WHEN 10 * n_date > 9 * total THEN 'Date' ELSE 'Text' END AS guess FROM v),
a AS (SELECT *, CASE WHEN total = 0 THEN true WHEN guess <> 'Text' THEN false ELSE 10 * greatest(n_int, n_float, n_bool, n_date) > 3 * total END AS ambiguous FROM g)"""


def _stacked(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", *[F.expr(e).alias(c) for c, e in _COLUMNS.items()])


@query(f"WITH s AS (SELECT *, trim(v) AS t FROM ({_STACK})), {_VOTE} SELECT * FROM a")
def column_vote(spark, d):
    row = vote.counted(_stacked(spark, d), list(_COLUMNS))
    out = []
    for c in _COLUMNS:
        v = vote.votes(row, c)
        guess, sure = vote.rules(c, v)
        out.append((c, v.total, v.Integer, v.Float, v.Boolean, v.Date, guess, vote.is_ambiguous(guess, sure, v)))
    return spark.createDataFrame(out, "col string, total long, n_int long, n_float long, n_bool long, n_date long, guess string, ambiguous boolean")


_CONVERTED = f"""c AS (SELECT s.col, o_orderkey, t, CASE WHEN t = '' THEN NULL WHEN ambiguous THEN {_CELL_SQL}
  WHEN guess = 'Integer' AND {_INT} THEN 'int' WHEN guess = 'Float' AND {_FLOAT} AND NOT regexp_full_match(t, '-?[0-9]+') THEN 'float'
  WHEN guess = 'Boolean' AND {_BOOL} THEN 'bool' ELSE 'text' END AS k FROM s JOIN a ON a.col = s.col)"""


@query(f"""WITH s AS (SELECT *, trim(v) AS t FROM ({_STACK})), {_VOTE}, {_CONVERTED}
SELECT col, coalesce(k, 'null') AS kind, count(*) AS n, CAST(sum(CASE WHEN k = 'int' THEN TRY_CAST(t AS BIGINT) END) AS BIGINT) AS sum_int,
  round(sum(CASE WHEN k = 'float' THEN TRY_CAST(t AS DOUBLE) END), 2) AS sum_float, count(*) FILTER (k = 'bool' AND lower(t) IN ('true', 'yes')) AS n_true FROM c GROUP BY ALL""")
def column_convert(spark, d):
    from grainworks.plans.model import Report

    wide = _stacked(spark, d)
    raw = wide.select(F.col("o_orderkey").alias("_row"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(_COLUMNS)])
    counts = vote.counted(raw, [f"c{i}" for i in range(len(_COLUMNS))])
    typed = vote.type_columns(raw, list(_COLUMNS), counts, Report("orders", "csv"))

    def as_cell(i):
        c, t = F.col(f"c{i}"), typed.schema[f"c{i}"].dataType
        kind = cells.kind_of(c, t)
        pick = lambda f, k, kind_name: c[f] if cells.is_cell(t) else F.when(kind == k, c).cast(kind_name)
        return F.struct(F.lit(list(_COLUMNS)[i]).alias("col"), F.coalesce(kind, F.lit("null")).alias("kind"), pick("i", "int", "bigint").alias("i") if cells.is_cell(t) or t.simpleString() == "bigint" else F.lit(None).cast("bigint").alias("i"), (c["f"] if cells.is_cell(t) else c if t.simpleString() == "double" else F.lit(None).cast("double")).alias("f"), (c["b"] if cells.is_cell(t) else c if t.simpleString() == "boolean" else F.lit(None).cast("boolean")).alias("b"))

    long = typed.select(F.explode(F.array(*[as_cell(i) for i in range(len(_COLUMNS))])).alias("x")).select("x.*")
    return long.groupBy("col", "kind").agg(F.count("*").alias("n"), F.sum("i").alias("sum_int"), F.round(F.sum("f"), 2).alias("sum_float"), F.count_if(F.coalesce("b", F.lit(False))).alias("n_true"))


_DATES = "CASE o_orderkey % 5 WHEN 0 THEN concat('2024-1-', CAST(o_orderkey % 28 AS {s})) WHEN 1 THEN concat('31/12/', CAST(o_orderkey AS {s})) WHEN 2 THEN '1.2.3.4' WHEN 3 THEN concat('20-', CAST(o_orderkey AS {s})) ELSE 'May 2024' END"


@query(f"SELECT o_orderkey, {_DATE} AS is_date FROM (SELECT o_orderkey, {_DATES.format(s='VARCHAR')} AS t FROM orders)")
def date_shape(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", cells.looks_like_date(F.expr(_DATES.format(s="STRING"))).alias("is_date"))


# -- widths, headers, delimiters ----------------------------------------------------------------------------------

_LINE = "CASE WHEN p_partkey % 11 = 0 THEN concat_ws('|', CAST(p_partkey AS {s}), p_name) WHEN p_partkey % 7 = 0 THEN concat_ws('|', CAST(p_partkey AS {s}), p_name, p_brand, CAST(p_size AS {s}), 'extra') ELSE concat_ws('|', CAST(p_partkey AS {s}), p_name, p_brand, CAST(p_size AS {s})) END"
_PARTS = f"SELECT p_partkey, string_split({_LINE.format(s='VARCHAR')}, '|') AS f FROM part"


def _part_fields(spark, d):
    from grainworks.sources.delimited import tokens

    return _t(spark, d, "part").select("p_partkey", tokens(F.expr(_LINE.format(s="STRING")), "|").alias("f"))


@query(f"SELECT CAST(len(f) AS BIGINT) AS width, count(*) AS n FROM ({_PARTS}) GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1")
def modal_width(spark, d):
    from collections import Counter

    widths = Counter({r["w"]: r["n"] for r in _part_fields(spark, d).groupBy(F.size("f").alias("w")).agg(F.count("*").alias("n")).collect()})
    width = shape.modal_width(widths)
    return spark.createDataFrame([(width, widths[width])], "width long, n long")


@query(f"SELECT p_partkey, coalesce(f[1], '') AS c0, coalesce(f[2], '') AS c1, coalesce(f[3], '') AS c2, coalesce(f[4], '') AS c3, len(f) <> 4 AS misfit FROM ({_PARTS})")
def ragged_repair(spark, d):
    df = _part_fields(spark, d)
    return df.select("p_partkey", *[F.coalesce(c, F.lit("")).alias(f"c{i}") for i, c in enumerate(shape.fitted(F.col("f"), 4))], (F.size("f") != 4).alias("misfit"))


@query("""WITH h AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS pos, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM h)
SELECT pos, CASE WHEN k = 1 THEN name ELSE concat(name, '_', CAST(k AS VARCHAR)) END AS header FROM r""")
def header_dedupe(spark, d):
    names = [r[0] for r in _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").select("r_name").collect()]  # a header: one line
    return spark.createDataFrame(list(enumerate(shape.numbered(names), 1)), "pos long, header string")


_SUPPLIER = "CASE s_suppkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE chr(9) END"
_SUPPLIER_LINE = "concat(CAST(s_suppkey AS {s}), d, '\"', s_name, d, 'Ltd, Co\"', d, CAST(s_nationkey AS {s}), CASE WHEN s_suppkey % 12 = 0 THEN d ELSE '' END)"


@query(f"""WITH l AS (SELECT s_suppkey % 4 AS grp, regexp_replace({_SUPPLIER_LINE.format(s='VARCHAR')}, '"[^"]*("|$)', '', 'g') AS bare FROM (SELECT *, {_SUPPLIER} AS d FROM supplier)),
c AS (SELECT grp, x.delimiter, length(bare) - length(replace(bare, x.delimiter, '')) AS n FROM l, (VALUES (','), (';'), (chr(9)), ('|')) x(delimiter))
SELECT grp, delimiter, round(avg(n), 6) AS mean, round(avg(n) - var_pop(n), 6) AS score FROM c GROUP BY ALL""")
def delimiter_stats(spark, d):
    s = _t(spark, d, "supplier").withColumn("d", F.expr(_SUPPLIER)).select((F.col("s_suppkey") % 4).alias("grp"), F.expr(_SUPPLIER_LINE.format(s="STRING")).alias("line"))
    return sniff.delimiter_scores(s, "line", ["grp"]).select("grp", "delimiter", F.round("mean", 6).alias("mean"), F.round("score", 6).alias("score"))


_LINES = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, count(*) OVER (PARTITION BY doc_id) AS n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(line) <> ''"


def _by_text(spark, d, table: str, key: str, text: str, f, schema: str) -> DataFrame:
    """Rows of ``f(key, text)`` for every row of a table; a null text is left out."""

    def run(batches):
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            yield pd.DataFrame([row for k, t in zip(b[key], b[text]) if t is not None for row in f(k, t)], columns=names)

    return _t(spark, d, table).select(key, text).mapInPandas(run, schema)


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, line FROM ({_LINES}) WHERE n <= 4 OR pos <= 2 OR pos > n - 2")
def rep_lines(spark, d):
    return _by_text(spark, d, "documents", "doc_id", "text", lambda k, t: [(k, i, x) for i, x in enumerate(sniff.picked(t, 4), 1)], "doc_id long, pos long, line string")


_NAKED = """regexp_replace(line, '"[^"]*("|$)', '', 'g')"""


@query(rf"""WITH l AS (SELECT *, {_NAKED} AS bare FROM ({_LINES})),
k AS (SELECT doc_id, x.place, x.d, length(bare) - length(replace(bare, x.d, '')) AS k FROM l, (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')) x(place, d) WHERE n <= 30 OR pos <= 15 OR pos > n - 15),
b AS (SELECT doc_id, d FROM (SELECT doc_id, d, row_number() OVER (PARTITION BY doc_id ORDER BY m - v DESC, place) AS best FROM (SELECT doc_id, place, d, avg(k) AS m, var_pop(k) AS v FROM k GROUP BY ALL) WHERE m >= 0.5) WHERE best = 1),
c AS (SELECT l.doc_id, length(bare) - length(replace(bare, coalesce(d, ','), '')) AS k FROM l LEFT JOIN b ON b.doc_id = l.doc_id WHERE n <= 10 OR pos <= 5 OR pos > n - 5),
a AS (SELECT doc_id, count(*) AS lines, avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(k) AS m, var_pop(k) AS v FROM c GROUP BY doc_id)
SELECT t.doc_id, round(CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g'))) <= length(text) AND lines >= 2 AND p > 0.3 THEN 0.4 * p * (0.5 + 0.5 * least(1.0, greatest(0.0, 1 - v / (m * m + 1)))) ELSE 0.0 END, 4) AS score
FROM documents t LEFT JOIN a ON a.doc_id = t.doc_id WHERE text IS NOT NULL""")
def csv_sniff_score(spark, d):
    """How much each text looks like delimited data, by the engine's score of its bytes."""
    return _by_text(spark, d, "documents", "doc_id", "text", lambda k, t: [(k, round(sniff.csv_score(t.encode(), ""), 4))], "doc_id long, score double")


_ODD = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"


@query(f"""SELECT page_id, CAST(length(html) AS BIGINT) AS chars, CAST(length(html) - length(regexp_replace(html, '{_ODD}', '', 'g')) AS BIGINT) AS junk,
  100 * (length(html) - length(regexp_replace(html, '{_ODD}', '', 'g'))) > length(html) AS rejected FROM pages""")
def junk_ratio(spark, d):
    return _by_text(spark, d, "pages", "page_id", "html", lambda k, t: [(k, len(t), sniff.odd(t), bool(t) and sniff.is_junk(t))], "page_id long, chars long, junk long, rejected boolean")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS pos FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL),
t AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[ \t\r\f\v]+'), lambda x: x <> '') AS f FROM l), w AS (SELECT max(len(f)) AS width FROM t)
SELECT doc_id, pos, CAST(len(f) AS BIGINT) AS tokens, coalesce(f[1], '') AS first, len(f) <> (SELECT width FROM w) AS ragged FROM t""")
def ws_tokens(spark, d):
    """Tokens of every line, blank ones too; the width is the most tokens of any line, and a null text is one row."""
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("p", "line"))
    t = lines.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.filter(F.split("line", r"[ \t\r\f\x0B]+"), lambda x: x != "").alias("f"))
    w = t.agg(F.max(F.size("f")).alias("width"))
    return t.join(F.broadcast(w)).select("doc_id", "pos", F.size("f").cast("long").alias("tokens"), F.coalesce(F.get("f", F.lit(0)), F.lit("")).alias("first"), (F.size("f") != F.col("width")).alias("ragged"))


_PADDED = "concat(rpad(CAST(c_custkey AS {s}), 8, ' '), rpad(c_mktsegment, 14, ' '), CAST(c_nationkey AS {s}))"
_SPANS = f"""l AS (SELECT c_custkey, {_PADDED.format(s='VARCHAR')} AS line FROM customer),
p AS (SELECT pos, bool_and(coalesce(substr(line, CAST(pos AS BIGINT), 1), '') IN ('', ' ')) AS gap FROM l, (SELECT unnest(range(1, 101)) AS pos) GROUP BY pos),
r AS (SELECT pos, gap, pos - row_number() OVER (PARTITION BY gap ORDER BY pos) AS island FROM p),
s AS (SELECT min(pos) - 1 AS lo, max(pos) AS hi, row_number() OVER (ORDER BY min(pos)) - 1 AS k FROM r WHERE NOT gap GROUP BY island)"""


def _padded(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.expr(_PADDED.format(s="STRING")).alias("line"))


@query(f"WITH {_SPANS} SELECT CAST(k AS BIGINT) AS k, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM s")
def fixed_spans(spark, d):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(shape.spans(_padded(spark, d), "line"))], "k long, lo long, hi long")


@query(f"WITH {_SPANS} SELECT c_custkey, CAST(k AS BIGINT) AS k, trim(substr(line, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT))) AS value FROM l, s")
def fixed_extract(spark, d):
    df = _padded(spark, d)
    spans = shape.spans(df, "line")
    return df.select("c_custkey", F.posexplode(F.array(*[cells.trimmed(F.substring("line", a + 1, b - a)) for a, b in spans])).alias("k", "value")).select("c_custkey", F.col("k").cast("long").alias("k"), "value")


# -- INI and nested data ------------------------------------------------------------------------------------------

_INI = "concat('[ev', CAST(event_id % 50 AS {s}), ']', chr(10), 'user = \"u', CAST(user_id AS {s}), '\" ; who', chr(10), '# note', chr(10), 'type=', event_type, chr(10), 'user = ', CAST(user_id % 10 AS {s}))"


@query("""SELECT event_id, concat('ev', CAST(event_id % 50 AS VARCHAR)) AS section, event_type AS type, CAST(user_id % 10 AS VARCHAR) AS "user" FROM events""")
def ini_rows(spark, d):
    """Each event as a small INI text, read by the engine: the last of equal keys wins, comments and quotes go."""
    from grainworks.sources.files import parse

    def rows(k, text):
        t = parse("ini", text.encode(), "a.ini", {})["tables"][0]
        return [(k, *[dict(zip(t["headers"], r))[c] for c in ("section", "type", "user")]) for r in t["rows"]]

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([x for k, t in zip(b["event_id"], b["text"]) for x in rows(k, t)], columns=["event_id", "section", "type", "user"])

    e = _t(spark, d, "events").select("event_id", F.expr(_INI.format(s="STRING")).alias("text"))
    return e.mapInPandas(run, "event_id long, section string, type string, user string")


_JSON = """concat('{"id": ', CAST(event_id AS {s}), ', "who": {"user": ', CAST(user_id AS {s}), ', "kind": "', event_type, '"}, "tags": ["a", ', CAST(event_id % 3 AS {s}), ', null], "flag": "', CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE '007' END, '", "none": {}}')"""


@query("""SELECT event_id, event_id AS id, event_type AS "who.kind", user_id AS "who.user", concat('a; ', CAST(event_id % 3 AS VARCHAR), '; ') AS tags,
  CASE WHEN event_id % 2 = 0 THEN 'bool' ELSE 'text' END AS flag_kind, true AS none_is_null FROM events""")
def json_flatten(spark, d):
    e = _t(spark, d, "events").select("event_id", F.expr(_JSON.replace("{s}", "STRING")).alias("text"))

    def run(batches):
        import pandas as pd

        from grainworks.sources.trees import flatten, json_tree

        for batch in batches:
            rows = []
            for k, t in zip(batch["event_id"], batch["text"]):
                r = flatten(json_tree(t))[0]
                rows.append((k, r["id"][1], r["who.kind"][1], r["who.user"][1], r["tags"][1], r["flag"][0], r["none"] is None))
            yield pd.DataFrame(rows, columns=["event_id", "id", "who.kind", "who.user", "tags", "flag_kind", "none_is_null"])

    return e.mapInPandas(run, "event_id long, id long, `who.kind` string, `who.user` long, tags string, flag_kind string, none_is_null boolean")


@query("SELECT l_orderkey AS \"order\", l_partkey AS \"items.part\", CAST(l_linenumber AS BIGINT) AS \"items.line\" FROM lineitem")
def json_explode(spark, d):
    """Orders rebuilt as nested records, one row an item after exploding."""
    li = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.col("l_orderkey").alias("order"), F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"))).alias("items"))).alias("text"))

    def run(batches):
        import pandas as pd

        from grainworks.sources.trees import flatten, json_tree

        for batch in batches:
            rows = [(r["order"][1], r["items.part"][1], r["items.line"][1]) for t in batch["text"] for r in flatten(json_tree(t), explode=True)]
            yield pd.DataFrame(rows, columns=["order", "items.part", "items.line"])

    return li.select("text").mapInPandas(run, "order long, `items.part` long, `items.line` long")


@query("""SELECT conv_id, turn, text AS question, NULL::VARCHAR AS answer FROM conversations WHERE role = 'user'
UNION ALL BY NAME SELECT conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant'""")
def key_union_nullfill(spark, d):
    c = _t(spark, d, "conversations")
    users, others = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")), c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return users.unionByName(others, allowMissingColumns=True)


# -- fills and trims ----------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS priority FROM orders""")
def forward_fill(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("priority"))
    return shape.forward_fill(o, ["priority"], "o_orderkey", ["o_custkey"])


@query("""WITH c AS (SELECT c_custkey AS row, x.col, CASE WHEN c_custkey % 5 = 0 OR x.col = 2 THEN concat('v', CAST(c_custkey AS VARCHAR)) END AS value FROM customer, (VALUES (0), (1), (2)) x(col)),
g AS (SELECT c_custkey AS r1, c_custkey + 4 AS r2, 0 AS c1, 1 AS c2, concat('v', CAST(c_custkey AS VARCHAR)) AS value FROM customer WHERE c_custkey % 10 = 0)
SELECT CAST(c.row AS BIGINT) AS row, CAST(c.col AS BIGINT) AS col, coalesce(c.value, g.value) AS value FROM c LEFT JOIN g ON c.row BETWEEN r1 AND r2 AND c.col BETWEEN c1 AND c2""")
def merge_region_fill(spark, d):
    c = _t(spark, d, "customer")
    v = F.concat(F.lit("v"), F.col("c_custkey").cast("string"))
    grid = c.select(F.col("c_custkey").alias("row"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("col"), v.alias("v")).select("row", "col", F.when((F.col("row") % 5 == 0) | (F.col("col") == 2), F.col("v")).alias("value"))
    regions = c.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("r1"), (F.col("c_custkey") + 4).alias("r2"), F.lit(0).alias("c1"), F.lit(1).alias("c2"), v.alias("value"))
    return shape.region_fill(grid, regions)


@query("""WITH p AS (SELECT s_suppkey AS row, CASE WHEN s_suppkey <= 3 OR s_suppkey > 95 THEN s_suppkey % 2 ELSE 2 + s_suppkey % 3 END AS populated FROM supplier),
b AS (SELECT min(row) FILTER (populated >= 2) AS head, max(row) FILTER (populated >= 2) AS tail FROM p)
SELECT CAST(row AS BIGINT) AS row, CAST(populated AS BIGINT) AS populated FROM p, b WHERE row > head AND row <= tail""")
def junk_trim(spark, d):
    p = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("row"), F.expr("CASE WHEN s_suppkey <= 3 OR s_suppkey > 95 THEN s_suppkey % 2 ELSE 2 + s_suppkey % 3 END").cast("long").alias("populated"))
    head, tail = shape.data_rows(p, p.agg(F.max("populated")).first()[0])
    return p.where((F.col("row") > head) & (F.col("row") <= tail))


_GLYPH_WIDTH = 6.0
_GLYPH = "SELECT l_orderkey, l_linenumber, l_linenumber * 6.0 + CASE WHEN l_linenumber > 3 THEN (l_partkey % 4) * 6.0 ELSE 0.0 END AS x, chr(CAST(97 + l_suppkey % 26 AS INTEGER)) AS ch FROM lineitem"


@query(f"""WITH g AS ({_GLYPH}), d AS (SELECT *, x - lag(x) OVER (PARTITION BY l_orderkey ORDER BY x, l_linenumber, ch) AS gap FROM g),
u AS (SELECT CAST(greatest(coalesce(list_sort(list(gap))[CAST(count(*) // 2 + 1 AS BIGINT)], 5.0), 0.5) AS DOUBLE) AS unit FROM d WHERE gap > 0.01)
SELECT l_orderkey, string_agg(concat(CASE WHEN gap - 6.0 > 0.8 * unit THEN repeat(' ', CAST(greatest(1, round((gap - 6.0) / unit)) AS INTEGER)) ELSE '' END, ch), '' ORDER BY x, l_linenumber, ch) AS line FROM d, u GROUP BY l_orderkey""")
def glyph_row_text(spark, d):
    g = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_linenumber * 6.0D + CASE WHEN l_linenumber > 3 THEN (l_partkey % 4) * 6.0D ELSE 0.0D END").alias("x"), F.expr("chr(97 + l_suppkey % 26)").alias("ch"))
    g = g.withColumn("step", F.col("x") - F.lag("x").over(Window.partitionBy("l_orderkey").orderBy("x", "l_linenumber", "ch")))
    # the upper median of all steps, as in sources/pdf.py; a glyph is _GLYPH_WIDTH wide
    unit = g.where("step > 0.01").agg(F.greatest(F.coalesce(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY step DESC)"), F.lit(5.0)), F.lit(0.5)).alias("unit"))
    gap = F.col("step") - _GLYPH_WIDTH
    piece = F.concat(F.when(gap > JUMP * F.col("unit"), F.repeat(F.lit(" "), F.greatest(F.lit(1), F.round(gap / F.col("unit")).cast("int")))).otherwise(""), F.col("ch"))
    return g.join(F.broadcast(unit)).withColumn("piece", piece).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "l_linenumber", "ch", "piece"))), lambda s: s["piece"]), "").alias("line"))


# -- validation and sinks -----------------------------------------------------------------------------------------


def _order_table(spark, d):
    amount = F.expr("CASE WHEN o_orderkey % 13 = 0 THEN 'oops' WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS STRING) ELSE concat(CAST(o_custkey AS STRING), '.5') END")
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("_row"), F.col("o_orderkey").alias("c0"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("c1"), amount.alias("raw"))
    return Table(["id", "priority", "amount"], cells.inferred(o, {"c2": F.col("raw")}, ["_row", "c0", "c1"]), "orders")


_SCHEMA = validate.Schema([validate.ColumnRule("id", "text"), validate.ColumnRule("priority", "text", False), validate.ColumnRule("amount", "float"), validate.ColumnRule("gone", "any")], True)
_ISSUES = f"""SELECT NULL::BIGINT AS row, 'gone' AS "column", '{validate.MISSING_MESSAGE}' AS message
UNION ALL SELECT o_orderkey, 'priority', '{validate.NULL_MESSAGE}' FROM orders WHERE o_orderkey % 9 = 0
UNION ALL SELECT o_orderkey, 'amount', 'should be float but is text: oops' FROM orders WHERE o_orderkey % 13 = 0"""


@query(_ISSUES)
def validate_issues(spark, d):
    return validate.issues(_order_table(spark, d), _SCHEMA).drop("place")


@query(f'SELECT "column", count(*) AS issues, count(row) AS row_issues FROM ({_ISSUES}) GROUP BY 1')
def validate_summary(spark, d):
    return validate.issues(_order_table(spark, d), _SCHEMA).groupBy("column").agg(F.count("*").alias("issues"), F.count("row").alias("row_issues"))


#: one column of each plan, over all rows
_PLANNED = ["raw", "CASE n % 3 WHEN 0 THEN '+42' WHEN 1 THEN k ELSE '' END", "CASE n % 2 WHEN 0 THEN concat(k, '.25') ELSE k END", "CASE n % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE 'TRUE' END"]


@query(f"""WITH n AS (SELECT l_orderkey * 3 + l_linenumber AS n, CAST(l_orderkey AS VARCHAR) AS k FROM lineitem), m AS (SELECT n, k, {_MESS} AS raw FROM n),
t AS ({" UNION ALL ".join(f"SELECT {i} AS grp, trim({e}) AS t FROM m" for i, e in enumerate(_PLANNED))}), c AS (SELECT grp, {_CELL_SQL} AS k FROM t)
SELECT CAST(grp AS BIGINT) AS grp, CASE WHEN count(k) = 0 THEN 'text' WHEN count(*) FILTER (k = 'int') = count(k) THEN 'int' WHEN count(*) FILTER (k IN ('int', 'float')) = count(k) THEN 'float' WHEN count(*) FILTER (k = 'bool') = count(k) THEN 'bool' ELSE 'text' END AS plan FROM c GROUP BY grp""")
def sink_plan(spark, d):
    wide = cells.inferred(_mess(spark, d).withColumn("_row", F.lit(0)), {f"c{i}": F.expr(e) for i, e in enumerate(_PLANNED)}, ["_row"])
    return spark.createDataFrame(list(enumerate(sinks.column_plan(Table([f"g{i}" for i in range(4)], wide)))), "grp long, plan string")


_NOTE = "CASE c_custkey % 4 WHEN 0 THEN concat('a,', c_mktsegment) WHEN 1 THEN concat('say \"', c_name, '\"') WHEN 2 THEN '' ELSE c_name END"


@query(f"""WITH n AS (SELECT c_custkey, {_NOTE} AS note FROM customer)
SELECT c_custkey, concat_ws(',', CAST(c_custkey AS VARCHAR), CASE WHEN regexp_matches(note, '[",]') THEN concat('"', replace(note, '"', '""'), '"') ELSE note END, concat(CAST(c_custkey AS VARCHAR), '.5')) AS line FROM n""")
def csv_render(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("_row"), F.col("c_custkey").alias("c0"), F.expr(_NOTE).alias("c1"), (F.col("c_custkey") + 0.5).cast("double").alias("c2"))
    return sinks.csv_lines(Table(["id", "note", "half"], c)).select(F.col("_row").alias("c_custkey"), F.col("value").alias("line"))


@query("""WITH f AS (SELECT page_id, concat('f', CAST(page_id % 100 AS VARCHAR)) AS stem, CASE WHEN page_id % 3 = 0 THEN 'csv' ELSE 'json' END AS ext FROM pages)
SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN concat(stem, '_', ext) ELSE stem END AS name FROM f""")
def dedupe_stems(spark, d):
    f = _t(spark, d, "pages").select("page_id", F.concat(F.lit("f"), (F.col("page_id") % 100).cast("string")).alias("stem"), F.when(F.col("page_id") % 3 == 0, "csv").otherwise("json").alias("ext"))
    return shape.disambiguated_stems(f).select("page_id", "name")


@query("SELECT p_partkey, regexp_replace(concat(p_brand, ' (', p_type, ')'), '[^A-Za-z0-9]', '_', 'g') AS suffix FROM part")
def safe_suffix(spark, d):
    return _t(spark, d, "part").select("p_partkey", shape.safe_suffix(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))).alias("suffix"))


@query("SELECT doc_id, concat('<blob: ', CAST(octet_length(encode(text)) AS VARCHAR), ' bytes>') AS shown FROM documents")
def blob_placeholder(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.format_string("<blob: %d bytes>", F.octet_length("text")).alias("shown"))


@query("SELECT p_partkey, lower(hex(encode(p_name))) AS digits FROM part")
def hex_text(spark, d):
    from pyspark.sql.types import BinaryType

    from grainworks.sources.columnar import shown

    return _t(spark, d, "part").select("p_partkey", shown(F.col("p_name").cast("binary"), BinaryType()).alias("digits"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS moment, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def iso_render(spark, d):
    from pyspark.sql.types import DateType, TimestampNTZType

    from grainworks.sources.columnar import shown

    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("t"))
    return o.select("o_orderkey", shown(F.col("t"), TimestampNTZType()).alias("moment"), shown(F.col("t").cast("date"), DateType()).alias("day"))


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows_out FROM {t}" for t in _TABLES))
def report_rollup(spark, d):
    from grainworks.plans.pipeline import rollup

    out = None
    for t in _TABLES:
        one = _t(spark, d, t).agg(F.count("*").alias("rows_in")).select(F.lit(t).alias("detected_format"), "rows_in", F.col("rows_in").alias("rows_out"))
        out = one if out is None else out.unionByName(one)
    return rollup(out).select(F.col("detected_format").alias("name"), "rows_out")


_OLD = "concat(CAST(s_suppkey AS {s}), ',', s_name)"
_NEW = "concat(CAST(s_suppkey AS {s}), ',', CASE WHEN s_suppkey % 10 = 0 THEN upper(s_name) ELSE s_name END)"


@query(f"""WITH a AS (SELECT {_OLD.format(s='VARCHAR')} AS line FROM supplier), b AS (SELECT {_NEW.format(s='VARCHAR')} AS line FROM supplier)
SELECT '-' AS side, line FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT '+', line FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def diff_lines(spark, d):
    s = _t(spark, d, "supplier")
    a, b = s.select(F.expr(_OLD.format(s="STRING")).alias("line")), s.select(F.expr(_NEW.format(s="STRING")).alias("line"))
    return a.exceptAll(b).select(F.lit("-").alias("side"), "line").unionByName(b.exceptAll(a).select(F.lit("+").alias("side"), "line"))


@query(f"WITH m AS ({_MESS_SQL}) SELECT count(*) AS n, CAST(0 AS BIGINT) AS changed FROM m")
def idempotent_pass(spark, d):
    """Cleaning a cleaned value again changes nothing."""
    once = cells.inferred(_mess(spark, d), {"a": F.col("raw")})
    t = once.schema["a"].dataType
    text = lambda df, c, to, *keep: df.select(*keep, cells.export_text(F.col(c), t).alias(to))
    twice = text(cells.inferred(text(once, "a", "said"), {"b": F.col("said")}, ["said"]), "b", "again", "said")
    return twice.agg(F.count("*").alias("n"), F.count_if(F.col("said") != F.col("again")).alias("changed"))


@query("SELECT s_suppkey AS supplier_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")
def csv_clean(spark, d):
    """The flagship: suppliers as a messy delimited text, cleaned back into a typed table."""
    return _flagship(spark, d)


def _flagship(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    from grainworks.plans.pipeline import read

    s = _t(spark, d, "supplier")
    line = F.concat_ws(";", F.concat(F.lit(" "), F.col("s_suppkey").cast("string")), F.concat(F.lit('"'), F.col("s_name"), F.lit('"')), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 9 == 0, F.lit("extra")))
    folder = _scratch(spark) + f"/messy-{uuid.uuid4().hex}"
    head = spark.createDataFrame([("supplier_id ;name; nation",)], "value string")
    head.coalesce(1).unionByName(s.select(line.alias("value"))).coalesce(1).write.text(folder)
    out = read(spark, folder, "csv")
    t = out.tables[0]
    return t.df.select(*[F.col(c).alias(h) for c, h in zip(t.columns(), t.headers)])


def _scratch(spark: SparkSession) -> str:
    import tempfile

    return spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="grainworks-")


from grainworks import file_queries  # noqa: E402, F401  adds its queries
