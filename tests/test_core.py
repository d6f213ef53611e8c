import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from lexmill.functions import rows, shingles, text
from lexmill.operators import bpe, clean, dedup, evaluate, lid, mixture, report
from lexmill.plans import catalogue


def test_chunks():
    assert clean.chunks_of("aaaa. bbbb", 8) == ["aaaa.", "bbbb"]
    assert clean.chunks_of("aa. bbbbbb", 8) == ["aa. bbbb", "bb"]
    assert clean.chunks_of(" " * 20, 8) == []


def test_cascade_names_the_first_failure(spark):
    rows = [(0, "x" * 99), (1, "word " * 40), (2, None), (3, "# % & " * 50)]
    got = {r.id: r.reason for r in clean.clean(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got[0] == "too_short" and got[2] == "too_short" and got[3] == "low_alpha_ratio" and got[1] == "repeated_ngrams"


def test_normalize(spark):
    d = spark.createDataFrame([("a\r\nb\x00 c\n\n\n\nd 1.2.3.4 x.y@example.org e\u0306",)], "text string")
    r = clean.clean(d).first()
    assert r.clean_text == "a\nb c\n\nd \u0115" and r.tx.control_chars_removed == 1 and r.tx.emails_redacted == 1 and r.tx.ipv4_redacted == 1


def test_survivors_of_a_chain(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    got = {r.id: (r.kept, r.near_duplicate_of) for r in dedup.greedy_survivors(docs, pairs, "id", F.col("id")).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None)}


def test_prefix_skip_fit_and_crossing(spark):
    d = spark.createDataFrame([("s", k, n) for k, n in enumerate((40, 50, 30, 5))], "source string, k long, n long")
    take = lambda x: sorted(r.n for r in x.collect())
    assert take(mixture.capped_mixture(d, ["s"], {}, 100, "source", "n", [F.col("k")])) == [40, 50]
    assert take(mixture.skip_fit(d, {"s": 100}, "source", "k", "n")) == [5, 40, 50]
    assert take(dedup.accept_until(d, "n", 100, ["source"], [F.col("k")])) == [30, 40, 50]


def test_quotas(spark):
    d = spark.createDataFrame([(k, 1) for k in "abc"], "k string, n long")
    assert {r.k: r.quota for r in mixture.largest_remainder(d, "k", "n", 2).collect()} == {"a": 0, "b": 1, "c": 1}


def test_bpe():
    assert bpe.sequential("abc  123") == ["abc", "  ", "123"]
    m = bpe.merge_loop({"abab": 5, "abc": 3, "é ж": 2}, 300)
    for t in ("abab abc", "é ж\n\U0001f600", ""):
        assert m.decode(m.encode(t)) == t
        assert bpe.Model.from_json(m.to_json()).encode(t) == m.encode(t)
    assert m.merges[0] == (b"a", b"b") and len(m.variant(256).merges) == 0


def test_pareto(spark):
    d = spark.createDataFrame([(32, 8.9, 6.4), (40, 8.9, 6.4), (50, 9.2, 6.0)], "v int, a double, b double")
    assert sorted(r.v for r in evaluate.pareto_front(d, ["v"], ["a", "b"]).collect()) == [32, 50]


def run(spark, path, name, texts):
    """The rows of a query over documents of these texts, numbered from 0."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    return catalogue.QUERIES[name](spark, str(path)).collect()


def test_truncation_of_all_documents(spark, tmp_path):
    long_ = "a few words " * 300
    texts = [long_, "short\n\ntext", None, "", long_[:1500] + "\n\n" + long_, long_[:1200] + "\n\n" + long_[:300] + "\n" + long_, long_[:500] + "\n\n" + long_, long_[:500] + "\n\n" + long_[:900] + "\n" + long_, long_[:1000] + "\n\n" + long_, long_[:999] + "\n\n" + long_, long_[:1999] + "\n\n" + long_, long_[:1997] + "\n\n\n" + long_]

    def brute(t):
        if t is None or len(t) <= 2000:
            return t
        head = t[:2000]
        end = next((k for k in (head.rfind("\n\n"), head.rfind("\n")) if k >= 1000), 2000)
        return head[:end].strip()

    assert {x.doc_id: x.cut for x in run(spark, tmp_path, "truncate_all_documents", texts)} == {k: brute(t) for k, t in enumerate(texts)}


def test_lsh_pairs_of_short_texts(spark, tmp_path):
    texts = ["one two three four five six", "One two three four five six", "two words", "two words", "", "", None, "something else"]
    assert {(x.a, x.b) for x in run(spark, tmp_path, "lsh_near_pairs", texts)} == {(0, 1), (2, 3)}


def test_bpe_queries_train_on_documents(spark, tmp_path):
    spark.createDataFrame([(1, "qz qz qz")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = ["ab ab ab abab", "\x00\x07 \ufeff\u2028\U0001f600 \u4e2d", "x1 " * 5000, "", None]
    assert run(spark, tmp_path, "bpe_first_merges", texts)[0][1:] == ("20", "78")
    got = catalogue.QUERIES["bpe_roundtrip_documents"](spark, str(tmp_path)).first()
    assert (got.records, got.failures) == (5, 0)


def test_strip_is_for_white_space_of_any_kind(spark):
    texts = ["\t a b  ", " 　\x1c\x85 ", "", " \n x\n\n", "a​ ", "\r\n\x0b\x0cé"]
    d = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert [r[0] for r in d.select(text.strip(F.col("t"))).collect()] == [t.strip() for t in texts] + [None]
    lines = spark.createDataFrame([("a\n\t \nb",)], "t string")
    assert [r[0] for r in bpe.lines_with_ends(lines, "t").collect()] == ["a\n", "b"]


def test_bpe_training_beyond_the_driver_and_blocks(spark):
    texts = ["aaab aaaa abab bcbc abcabc aaa", "Straße é\U0001f600é ab ab", "", None, "  abab\n\nbcb 12 345 ab-ab"] + [f"word{k % 7}{k} abc{k % 3}" for k in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    counts = {r.pretoken: r.n for r in bpe.pretoken_counts(d, "text", "cased").collect()}
    for size, longest in ((300, 64), (330, 3), (5000, 64)):
        want = bpe.merge_loop(counts, size, 2, longest)
        for most in (1, 20, 10_000):
            got = bpe.train(d, "text", size, max_token_length=longest, most_pretokens=most)
            assert (got.merges, got.vocab) == (want.merges, want.vocab), (size, longest, most)
    ok = d.withColumn("ok", bpe.round_trip(d, want, "text")).collect()
    assert all(r.ok for r in ok) and len(ok) == len(texts)
    broken = bpe.Model(want.merges, "cased", [v if v != b"a" else b"?" for v in want.vocab])
    broken.ids[b"a"] = want.ids[b"a"]
    assert {r.text for r in d.withColumn("ok", bpe.round_trip(d, broken, "text")).where("not ok").collect()} >= {"aaab aaaa abab bcbc abcabc aaa"}
    assert {r.id: r.tokens for r in bpe.token_lengths(d, want, "id", "text").collect()} == {k: len(want.encode(t or "")) for k, t in enumerate(texts)}


def test_words_are_encoded_at_once_as_one_by_one():
    # b"abc" is made by two merges; the later one makes a pair of lower rank with what follows.
    m = bpe.Model([(b"a", b"b"), (b"ab", b"c"), (b"abc", b"d"), (b"b", b"x"), (b"b", b"c"), (b"a", b"bc")])
    m.merges = [(b"b", b"c"), (b"ab", b"c"), (b"abc", b"d"), (b"a", b"bc")]
    m.ranks = {p: k for k, p in enumerate(m.merges)}
    words = ["abcd", "", "aaaa", "bcd", "xabcdabcd", "é"]
    ids, sizes = bpe.encode_words(m, pa.array(words))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [m.encode_piece(w) for w in words]
    assert m.decode(m.encode_piece("abcd")) == "abcd" and len(m.encode_piece("abcd")) == 1


def test_near_pairs_and_survivors_by_classes(spark, tmp_path):
    """Equal sets, near copies, chains and short texts against plain loops; no pair of equal sets is made for the decisions."""
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base), "A B  c d, e!", "a b c d e", None, "", "one two", "One, two", "é"]
    for k in range(30):
        words = [f"x{k % 4}y{j}" for j in range(30 + k % 3)]
        words[-1 - k % 5] = f"z{k // 6}"
        texts.append(" ".join(words) + (" " + " ".join(base[:k]) if k % 2 else ""))
    texts += [" ".join(base[k:]) + " " + " ".join(base[:k]) for k in range(0, 9, 2)] + texts[:3] * 4
    sets = {}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    pairs = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert {(r.a, r.b): (r.shared, r.size_a, r.size_b) for r in run(spark, tmp_path / "p", "shingle_jaccard_pairs", texts)} == {(a, b): (s, len(sets[a]), len(sets[b])) for (a, b), s in pairs.items()}
    assert {(r.a, r.b) for r in run(spark, tmp_path / "l", "lsh_near_pairs", texts)} <= pairs.keys()

    def greedy(order):
        of, kept = {}, []
        for k in order:
            near = [j for j in kept if (min(j, k), max(j, k)) in pairs]
            of[k] = min(near, default=None)
            kept += [k] if not near else []
        return of

    d = spark.createDataFrame([(k, t, -k * 7 % 64) for k, t in enumerate(texts)], "doc_id long, text string, o long")
    assert len({r.o for r in d.collect()}) == len(texts)
    for key, order in ((F.col("doc_id"), sorted(sets)), (F.col("o"), sorted(sets, key=lambda k: -k * 7 % 64))):
        want = greedy(order)
        got = {r.doc_id: (r.kept, r.near_duplicate_of) for r in dedup.near_survivors(d, "doc_id", "text", key).collect()}
        assert got == {k: (v is None, v) for k, v in want.items()}
    copies = spark.createDataFrame([(k, "a b c d e f") for k in range(3000)], "doc_id long, text string")
    members, made = dedup.class_pairs(copies, "doc_id", "text")
    assert members.count() == 3000 and made.count() == 0
    assert dedup.similar_pairs(copies, "doc_id", "text").count() == 3000 * 2999 // 2


def test_hashes_are_those_of_spark(spark):
    texts = ["a b c d e f g", "one", "é ü straße " * 30 + "zz", "w" * 40 + " " + "v" * 33 + " x y z 12", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r.id: (sorted(r.h), r.m) for r in d.select("id", F.transform(dedup.shingles(F.col("text")), lambda x: F.xxhash64(x)).alias("h"), dedup.minhash(F.col("text"), 20).alias("m")).where("text is not null").collect()}
    joined = [r.t for r in dedup._joined(d, "id", "text").orderBy("id").collect()]
    found = dict(shingles.sets(pa.array(joined, pa.string()), 5, shingles.xxhash))
    seeds = (np.arange(20) + 1_000_003).astype(np.uint64)[:, None]
    for k, (hashes, least) in want.items():
        assert sorted(shingles.signed(found[k]).tolist()) == hashes
        if hashes:
            h = shingles.xxhash_long(found[k], np.uint64(42))
            assert shingles.xxhash_int(seeds, h[None, :]).view(np.int64).min(1).tolist() == least


def test_workers_hold_few_rows_and_no_text_in_vain(spark):
    d = spark.range(3 * rows.SLICE + 7).repartition(1).select("id", F.concat(F.lit("“Größe” – "), "id").alias("t"), F.concat(F.lit("e\u0301"), "id").alias("u"))
    seen = rows.by_slices(lambda values: [len(values)] * len(values), IntegerType())
    assert d.select(F.max(seen("t"))).first()[0] == rows.SLICE
    asked = rows.each(lambda t: "asked", StringType())
    assert d.select("t", "u", asked(F.when(F.col("t").rlike(text.COMPOSES), F.col("t"))).alias("a"), asked(F.when(F.col("u").rlike(text.COMPOSES), F.col("u"))).alias("b")).where("a is null and b = 'asked'").count() == d.count()
    assert d.select(text.nfc(F.col("t")) == F.col("t"), text.nfc(F.col("u")) == F.concat(F.lit("\u00e9"), "id")).distinct().collect() == [(True, True)]


def test_composing_characters_are_covered():
    first, inside = {}, re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", text.COMPOSES))
    for c in map(chr, (k for k in range(0x110000) if not 0xD800 <= k < 0xE000)):
        parts = unicodedata.decomposition(c).split()
        if unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c:
            assert inside.match(c), hex(ord(c))
        elif len(parts) == 2 and not parts[0].startswith("<"):
            first[c] = chr(int(parts[1], 16))
    assert all(inside.match(c) for c in [*first.values(), *map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])])


def test_character_inventory_in_order_of_places(spark):
    texts = [(3, "bbaacc\U0001f600"), (1, "xy\n"), (2, None), (4, ""), (0, "ccé\U0001f600")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    flat = [c for _, t in sorted(texts) for c in t or ""]
    want = sorted(set(flat), key=lambda c: (-flat.count(c), flat.index(c)))
    for k in (2, 4, 50):
        got = report.characters(d, "text", ["doc_id"], k).collect()
        assert [(r.char, r.n) for r in got] == [(c, flat.count(c)) for c in want[:k]]
    assert {r.char: r.codepoint for r in got}["é"] == "U+00E9"
    assert report.characters(d.where("text = ''"), "text", ["doc_id"]).count() == 0


def test_naive_bayes_is_sparks_over_hashed_trigrams(spark):
    texts = [(k, f"{a} {b} {k}" * (k % 4), lang) for k, (a, b, lang) in enumerate([("der Hund läuft", "Straße", "de"), ("the dog runs", "street", "en"), ("le chien \U0001f600", "rue", "fr")] * 8 + [("ab", "x", None), ("", "", "en")])] + [(99, None, "de")]
    d = spark.createDataFrame(texts, "id long, text string, lang string")
    n = lid.NaiveBayesIdentifier().fit(d, "text", "lang")
    assert n.labels == ["de", "en", "fr"]
    counts = {x: np.zeros(n.features) for x in n.labels}
    seen = d.select("id", "lang", n._seen("text").alias("t"))
    letters = NGram(n=3, inputCol="l", outputCol="g").transform(seen.withColumn("l", F.split("t", "")))
    vectors = {r.id: (r.lang, r.x.toArray()) for r in HashingTF(numFeatures=n.features, inputCol="g", outputCol="x").transform(letters).collect()}
    for lang, x in vectors.values():
        if lang:
            counts[lang] += x
    theta = np.array([np.log(counts[x] + 1) - np.log(counts[x].sum() + n.features) for x in n.labels])
    assert np.allclose(theta, n.theta, rtol=0, atol=1e-12)
    for r in n.identify(d, "text").collect():
        raw = n.pi + theta @ vectors[r.id][1]
        p = np.exp(raw - raw.max())
        assert abs(r.lid.score - (p / p.sum()).max()) < 1e-9 and r.lid.label == max(zip(raw, n.labels))[1]
