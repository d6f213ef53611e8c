"""Readers, sinks, streaming ingest, the staged build and the command line, over small files."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill import cli
from lexmill.plans.corpus import Build, Config
from lexmill.sources import readers, sinks
from lexmill.streaming.ingest import ingest

PROSE = "The {0} river runs past {1} old stone mills before it turns south near the {2} bridge, where people of the village {0} meet every autumn to trade wool, honey and timber with those from {1} and {2}."


def prose(k):
    return PROSE.format(f"north{k}", f"grand{k * 7}", f"mill{k * 13}")


PAGE = "<page><title>{t}</title><ns>{ns}</ns><id>{i}</id>{extra}<revision><id>9{i}</id><text>{text}</text></revision></page>"


def test_wiki_dump(spark, tmp_path):
    pages = [
        PAGE.format(t="One", ns=0, i=1, extra="", text="'''One''' is [[Two|a link]] {{cite|{{x}}}} &lt;ref&gt;r&lt;/ref&gt;[[File:a.png|thumb|[[b]]]] end\n== Литература ==\nbook"),
        PAGE.format(t="Two", ns=0, i=2, extra="", text="body &lt;gallery&gt;a.png&lt;/gallery&gt;of it"),
        PAGE.format(t="Talk", ns=1, i=3, extra="", text="no"),
        PAGE.format(t="Moved", ns=0, i=4, extra='<redirect title="One"/>', text="#REDIRECT"),
        "<page><title>Bare</title><ns>0</ns><id>5</id></page>",
    ]
    (tmp_path / "d.xml").write_text("<mediawiki>" + "\n".join(pages) + "</mediawiki>")
    got = readers.wiki_dump(spark, str(tmp_path / "d.xml"), "wiki", "https://w.example/").orderBy("seq").collect()
    assert [(r.upstream_id, r.seq, r.url) for r in got] == [("1", 0, "https://w.example/?curid=1"), ("2", 1, "https://w.example/?curid=2")]
    assert got[0].text.startswith("One is a link") and "ref" not in got[0].text and "book" not in got[0].text and "thumb" not in got[0].text
    assert got[1].text == "Two\n\nbody of it" and got[1].metadata == {"title": "Two", "revision_id": "92"}


def test_vrt_plain_and_zipped(spark, tmp_path):
    data = '<text id="a&amp;b" source="http://x.example">\n<s>\nHello\tUH\n,\tP\nworld\tN\n.\tP\n</s>\n<s>\n</s>\n<s>\nBye\tV\n</s>\n</text>\n<text>\n<s>\nx\tN\n</s>\n</text>\n'
    (tmp_path / "a.vrt").write_text(data)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("in.vrt", data)
    got = readers.vrt(spark, str(tmp_path), "v").orderBy("seq").collect()
    assert len(got) == 4 and [r.seq for r in got] == [0, 1, 2, 3]
    assert got[0].upstream_id == "a&b" and got[0].url == "http://x.example" and got[0].text == "Hello, world.\nBye" and len(got[1].upstream_id) == 64 and got[1].url is None


def test_conllu(spark, tmp_path):
    row = lambda i, form, lemma: "\t".join([i, form, lemma, *"_______"])
    (tmp_path / "a.conllu").write_text("\n".join(["# sent_id = 1", "# text = ab cd", row("1-2", "abcd", "_"), row("1", "ab", "a"), row("1.1", "e", "e"), row("2", "cd", "_"), "3\tnine\tcolumns", ""]))
    texts, forms = readers.conllu(spark, str(tmp_path / "a.conllu"), "ud")
    assert [(r.dataset_id, r.text) for r in texts.collect()] == [("ud", "ab cd")]
    assert [(r.form, r.lemma) for r in forms.collect()] == [("ab", "a")]


def test_hub_rows_and_lines(spark, tmp_path):
    rows = [("a", "t0", "u"), (None, "t1", ""), ("0", "t2", None), ("b", "", "u"), ("c", None, "u")]
    spark.createDataFrame(rows, "id string, text string, url string").coalesce(1).write.parquet(str(tmp_path / "p"))
    got = readers.open_source(spark, "parquet", path=str(tmp_path / "p"), source_id="s", url_field="url", metadata_fields=("id", "absent")).orderBy("seq").collect()
    assert [(r.upstream_id, r.url) for r in got] == [("a", "u"), ("000000000001", None), ("0", None)] and got[0].metadata == {"id": "a"} and got[1].metadata == {}
    with gzip.open(tmp_path / "x.txt.gz", "wt") as f:
        f.write(" one \n\n  \ntwo\n")
    assert [r.text for r in readers.text_lines(spark, str(tmp_path / "x.txt.gz")).collect()] == ["one", "two"]
    with pytest.raises(ValueError):
        readers.open_source(spark, "nothing")
    with pytest.raises(ValueError):
        readers.verified(spark, str(tmp_path / "x.txt.gz"), "0" * 64)


def test_splits_and_shards(spark, tmp_path):
    d = spark.createDataFrame([("train", "a é"), ("train", "b"), ("validation", "c")], "split string, text string")
    sinks.write_splits(d, str(tmp_path / "out"), codec="none")
    back = spark.read.json(str(tmp_path / "out/jsonl")).groupBy("split").agg(F.sort_array(F.collect_list("text")).alias("t")).collect()
    assert {r.split: r.t for r in back} == {"train": ["a é", "b"], "validation": ["c"]}
    lines = [p.read_text() for p in (tmp_path / "out/text/split=validation").glob("*.txt")]
    assert "".join(lines) == "c\n\n"
    shards = sinks.shard_numbers(d, "split", F.octet_length("text"), [F.col("text")], most=6).orderBy("split", "text").collect()
    assert [r.shard for r in shards] == [0, 1, 0]
    # Each shard counts from 0 bytes again; splits keep apart, nulls included.
    sizes = [("a", k, n) for k, n in enumerate((150, 30, 30, 30, 400, 1, 1))] + [(None, k, 90) for k in range(4)]
    d = spark.createDataFrame(sizes, "split string, k long, size long")
    got = [r.shard for r in sinks.shard_numbers(d, "split", F.col("size") - 2, [F.col("k")], most=100).orderBy(F.col("split").desc_nulls_last(), "k").collect()]
    assert got == [0, 1, 1, 1, 1, 2, 2] + [0, 0, 1, 1]
    assert sinks.shard_numbers(d.limit(0), "split", F.col("size"), [F.col("k")]).count() == 0
    for kind, zero, want in (("long", 0, "000000000007"), ("double", 1.5, "1.5"), ("boolean", False, "000000000007"), ("string", "false", "false")):
        one = spark.createDataFrame([(zero, "t")], f"id {kind}, text string")
        assert readers.hub_rows(one, "s", seq=F.lit(7)).first().upstream_id == want
    assert {r["path"] for r in sinks.manifest(spark, str(tmp_path / "out/text/split=validation"))}


def test_ingest_takes_new_files_once(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = lambda ks: spark.createDataFrame([(f"d{k}", prose(k)) for k in ks], "upstream_id string, text string")
    for ks in ([1, 2, 2], [2, 3], []):
        frame(ks).write.mode("append").parquet(inbox)
        ingest(spark, inbox, "upstream_id string, text string", out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.upstream_id for r in spark.read.parquet(out).collect()) == ["d1", "d2", "d3"]


def config(spark, tmp_path, **more):
    rows = [(f"d{k}", prose(k)) for k in range(8)] + [("copy", prose(3)), ("short", "too short")]
    path = str(tmp_path / "src")
    spark.createDataFrame(rows, "id string, text string").coalesce(1).write.mode("overwrite").parquet(path)
    return {"sources": [{"source_id": "s", "kind": "parquet", "license": "cc0", "path": path}], "artifacts": str(tmp_path / "artifacts"), **more}


def test_build(spark, tmp_path):
    build = Build(spark, Config(**config(spark, tmp_path, threshold=0.95)))
    report = build.build()
    funnel = {r["reason"]: r["count"] for r in report["funnel"]}
    assert funnel["accepted"] == 9 and sum(funnel.values()) == 10
    assert build.accepted().count() == 8
    exported = spark.read.json(str(tmp_path / "artifacts/export/jsonl"))
    assert exported.count() == 8 and {"text", "license", "text_sha256", "split"} <= set(exported.columns)
    again = Build(spark, Config(**config(spark, tmp_path, threshold=0.95))).build()
    assert again == report


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps(config(spark, tmp_path)))
    assert cli.main(["corpus", "collect", "--config", str(tmp_path / "c.json")]) == 0
    assert capsys.readouterr().out.strip().splitlines()[-1] == "8"
    model = str(tmp_path / "m.json")
    assert cli.main(["tokenizer", "train", "--input", str(tmp_path / "src"), "--vocab-size", "300", "--model", model]) == 0
    assert cli.main(["tokenizer", "evaluate", "--input", str(tmp_path / "src"), "--model", model]) == 0
    assert cli.main(["tokenizer", "inspect", "--model", model, "--text", "the river"]) == 0
    assert "the" in capsys.readouterr().out
