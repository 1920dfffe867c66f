"""Large XML by splits, against the parse of the whole file by one task."""

import random

import pytest

from grainworks.plans import pipeline, sinks
from grainworks.plans.model import Options, ParseError
from grainworks.sources import files, xmlscan

ODD = [
    "<!-- a > b <p> -- ->  -->".replace("-- ->", "- >"), "<![CDATA[ <p id='1'> ]> ]] > x ]]>", "<?go a > b <p> ?>", "<q/>", "text > here", "<!---->", "<![CDATA[]]>",
    "<p/>", "<p a='x > y' b=\"it's > '\" c='/'/>", '<p id="7">a > b<n>1</n><n>2.50</n><n>007</n></p>', "<p><p>inner</p><p><p>deep</p></p></p>", "<p>yes</p>", "<o x='>'>\n<p>no record</p></o>",
    "<p><n>é ü 你好</n><m k=\"&lt;&gt;&amp;&#62;\"> t\n</m></p>", "<p>\n  <a><b>1</b></a><!-- > --><a><b>2</b><c/></a></p>\n", "<p>" + "<w v='a>b'>long</w>" * 30 + "</p>",
]


def document(seed: int, n: int, prolog: str = "", after: str = "\n") -> str:
    r = random.Random(seed)
    return f"{prolog}<all v='1 > 0'>" + "".join(r.choice(ODD) for _ in range(n)) + "</all >" + after


PROLOGS = ["", "﻿ \n", '<?xml version="1.0"?>\n<!-- > <all> -->\n', '<!DOCTYPE all [<!ENTITY e "x > y"> <!-- ]> --> <!ATTLIST p kind CDATA "plain > text">]>\n']


def shown(outcome):
    t = outcome.tables[0]
    return t.headers, sorted(tuple(x) for x in sinks.csv_lines(t).collect()), outcome.report


@pytest.mark.parametrize("piece,split,explode", [(1, 64, False), (300, 700, True), (1 << 20, 6000, False)])
def test_splits_give_what_the_whole_gives(spark, tmp_path, monkeypatch, piece, split, explode):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    options = Options({"array_mode": "explode"} if explode else {})
    for i, prolog in enumerate(PROLOGS):
        path = tmp_path / f"a{i}.xml"
        path.write_text(document(i, 60 if split < 100 else 400, prolog, ["\n", "", " <!-- > -->\n<?x >?>", "\n\n"][i]), encoding="utf-8")
        monkeypatch.setattr(xmlscan, "AT_ONCE", 1 << 40)
        want = shown(pipeline.read(spark, str(path), "json", options))
        monkeypatch.setattr(xmlscan, "AT_ONCE", 0)
        monkeypatch.setattr(xmlscan, "PIECE", piece)
        monkeypatch.setattr(files, "parse", None)
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            made = pipeline.read(spark, str(path), "json", options)
            assert made.tables[0].df.rdd.getNumPartitions() > 2 and not made.held
            assert shown(made) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        monkeypatch.undo()


def test_broken_xml_is_an_error_by_splits_too(spark, tmp_path, monkeypatch):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    body = "<p><n>1</n></p>" * 40
    broken = [f"<r>{body}", f"<r>{body}</r", f"<r>{body}</s>", f"<r>{body}<p><n></p></n>{body}</r>", f"<r>{body}</r><r>{body}</r>", f"<r>{body}</p></r>", f"<r>{body}</r>x", f"<r>{body}a ]]> b{body}</r>", f"<r>{body}&none;{body}</r>"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    monkeypatch.setattr(xmlscan, "AT_ONCE", 0)
    monkeypatch.setattr(files, "parse", None)
    try:
        for i, text in enumerate(broken):
            (tmp_path / f"b{i}.xml").write_text(text)
            with pytest.raises(ParseError, match="invalid XML"):
                pipeline.read(spark, str(tmp_path / f"b{i}.xml"), "json")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_xml_without_a_list_or_with_long_fragments_is_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xmlscan, "AT_ONCE", 0)
    (tmp_path / "a.xml").write_text("<r><p>1</p><q>2</q></r>")
    assert shown(pipeline.read(spark, str(tmp_path / "a.xml"), "json"))[:2] == (["p", "q"], [(0, "1,2")])
    (tmp_path / "b").write_text(" \n<r><p>1</p><p>2</p>" + "<!-- long -->" * 9 + "</r>")
    assert [x[1] for x in shown(pipeline.read(spark, str(tmp_path / "b"), "json"))[1]] == ["1", "2"]
    monkeypatch.setattr(xmlscan, "FRAGMENT", 3)
    assert xmlscan.read(spark, str(tmp_path / "b"), "b", Options(), 1) is None
    assert [x[1] for x in shown(pipeline.read(spark, str(tmp_path / "b"), "json"))[1]] == ["1", "2"]
