import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobweave.llm import fingerprint, graph, language, licenses, mixing, neardup, packing, pii, quality, suffix, tokens
from jobweave.llm.queries import vocabulary
from jobweave.llm.text import pieces, words
from jobweave.session import written
from tests.llm import brute
from tests.llm.conftest import edge_rows, sentence

ROWS = edge_rows()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def encode(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def as_batch(texts):
    return [pa.record_batch([pa.array(texts, pa.string())], ["text"])]


# ---- helpers

def test_words_of_pieces_of_any_size():
    texts = [t for _, t, *_ in ROWS]
    for most in (1, 500, 1 << 20):
        got = []
        for rows, data, at in pieces(iter(as_batch(texts)), most=most):
            start, end, row = words(data, at)
            own = [[] for _ in range(rows.num_rows)]
            for a, b, r in zip(start, end, row):
                own[r].append(data[a:b].tobytes().decode())
            got += own
        assert got == [brute.words(t) for t in texts]


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {300: 299}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 9, 1

def test_token_ids_are_the_librarys(library):
    rng = random.Random(1)
    letters = "ab cdé's t're  \n\t\r\x0b'll'd'm ve123½٣!?漢字🙂  \x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(rng.choice(["<|endoftext|>", "a", " ", "'", "s", "\n"]) for _ in range(8)) for _ in range(500)]
    texts += ["q" * 20_000, " " * 500, "don't", " 's", "\n's", "'sabc"]
    m, got = tokens.Merger(vocabulary()), []
    for _, data, at in pieces(iter(as_batch(texts)), most=4000):
        ids, of = m.encode(data, at)
        assert list(m.count(data, at)) == list(np.diff(of))
        got += [list(ids[a:b]) for a, b in zip(of[:-1], of[1:])]
    assert got == encode(library, texts)


def test_token_counts(spark, edge, nothing, library):
    out = tokens.count_tokens(edge, vocabulary(), limit=100)
    assert set(out.columns) == set(edge.columns) | {"n_bytes", "n_tokens", "over_limit"}
    got = Counter((r["doc_id"], r["text"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect())
    counts = [len(x) for x in encode(library, [t for _, t, *_ in ROWS])]
    assert got == Counter((i, t, len((t or "").encode()), n, n > 100) for (i, t, *_), n in zip(ROWS, counts))
    assert tokens.count_tokens(nothing, vocabulary()).count() == 0


def check_packing(rows, expected, size=2048):
    """Every id of every document in one piece, sequences gapless and full but for powers of two."""
    documents, sequences = brute.pieces_by_document(rows), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1])
        total = sum(n for _, n in own)
        assert total == size or total & (total - 1) == 0 and total < size
    parts = Counter()
    for doc, own in expected:
        parts[doc] += len(own)
    assert {d: sum(n for _, n, *_ in p) for d, p in documents.items()} == dict(parts)
    for doc, own in expected:
        for start, length, total, crc in documents[doc]:
            if total == len(own) and [1 for d, o in expected if d == doc and len(o) == total] == [1]:
                assert zlib.crc32(np.array(own[start:start + length], "<u4").tobytes()) == crc


def test_packing(spark, edge, nothing, library):
    rows = packing.pack(edge, vocabulary()).collect()
    check_packing(rows, [(i, ids + [1]) for (i, *_), ids in zip(ROWS, encode(library, [t for _, t, *_ in ROWS]))])
    small = packing.pack(edge.where("doc_id = 54"), vocabulary(), size=64).collect()
    check_packing(small, [(54, encode(library, [ROWS[18][1]])[0] + [1])], 64)
    assert packing.pack(nothing, vocabulary()).count() == 0


def test_hilbert_keys_are_a_path_of_unit_steps():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_keys(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark):
    rng = random.Random(5)
    kinds = [[f"{c}{i}" for i in range(30)] for c in ("red", "sea", "oak")]
    docs = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(120))) for i in range(90)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), vocabulary()).collect()
    order = [r["doc_id"] % 3 for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert sum(a == b for a, b in zip(order, order[1:])) > 0.7 * len(order)  # a third by chance


# ---- 2

def test_rule_counts_and_base_rules(edge, nothing, labels):
    got = Counter()
    for r in quality.quality_rules(edge, labels).collect():
        got[(r["doc_id"], r["text"], *(r[c] for c in quality.COUNTS), r["base_failed"])] += 1
        assert not (r["kept"] and r["base_failed"])
    want = Counter()
    for i, t, *_ in ROWS:
        n = brute.rule_counts(t)
        want[(i, t, *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    assert got == want
    assert quality.quality_rules(nothing, labels).count() == 0


def test_forest_parts_labelled_rows_and_keeps_clean_ones(spark):
    rng = random.Random(8)
    good = [(i, sentence(rng, rng.randint(60, 300)).replace("#", ""), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "###" for w in sentence(rng, 90).split()), 0) for i in range(30)]
    fresh = [(2000 + i, sentence(rng, rng.randint(60, 300)).replace("#", ""), None) for i in range(100)]
    junk = [(3000 + i, " ".join(w + "$$$" for w in sentence(rng, 90).split()), None) for i in range(20)]
    rows = spark.createDataFrame(good + bad + fresh + junk, "doc_id long, text string, quality long")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(rows.drop("quality"), rows).collect()}
    assert not any(got[i] for i, *_ in bad + junk)
    assert sum(got[i] for i, *_ in good + fresh) >= 0.98 * 250


def test_without_both_labels_only_the_base_rules_act(spark, edge, labels):
    for given in (labels.where("false"), labels.where("quality = 1")):
        assert quality.quality_rules(edge, given).where("kept = base_failed").count() == 0


# ---- 3

def test_fingerprints_follow_the_ring_and_estimate_similarity(spark, edge, nothing):
    ids = [r for r in ROWS if r[0] is not None and r[0] != 9]
    docs = spark.createDataFrame(ids, "doc_id long, text string, lang string, source string, n_chars long")
    rows = fingerprint.fingerprints(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ids)
    text = {i: t or "" for i, t, *_ in ids}
    order, got = sorted(text), {r["doc_id"]: r for r in rows}
    seen = {}
    for n, i in enumerate(order):
        after = text[order[(n + 1) % len(order)]]
        quarter = len(text[i]) // 4
        edited = text[i][:len(text[i]) - quarter] + after[:quarter]
        r = got[i]
        assert r["n_chars"] == len(text[i])
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text[i], r["fingerprint"]) == r["fingerprint"]
        for near, other in (("near_edited", edited), ("near_next", after)):
            a, b = brute.shingles(text[i]), brute.shingles(other)
            assert abs(r[near] - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.25
    assert fingerprint.fingerprints(edge).count() == len(ROWS)
    assert fingerprint.fingerprints(nothing).count() == 0


def test_estimate_is_unbiased(spark):
    rng = random.Random(2)
    pairs = []
    for i in range(200):
        w = sentence(rng, 120).split()
        v = w[:100] + sentence(rng, 20).split()
        pairs.append((" ".join(w), " ".join(v)))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprint.likeness(
        fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("x"))
    error = [r["x"] - len(brute.shingles(r["a"]) & brute.shingles(r["b"])) / len(brute.shingles(r["a"]) | brute.shingles(r["b"])) for r in df.collect()]
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.08


def test_single_document_is_its_own_neighbour(spark):
    r = fingerprint.fingerprints(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0


# ---- 4

def test_language_learns_from_three_fourths_and_predicts_the_rest(spark):
    rng = random.Random(4)
    kinds = {"xx": "the and of ing tion er".split(), "yy": "der und sch ung ein ä".split(), "zz": "que la eau é ois les".split()}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(rng.randint(3, 60))), k)
            for i in range(300) for k in [list(kinds)[i % 3]]]
    got = language.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: k for i, _, k in rows}
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) > 30


def test_held_out_labels_and_other_columns_change_nothing(spark, edge):
    def run(df):
        return sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in language.predict_language(df).collect()), key=repr)
    held = language.held_out(F.col("doc_id"))
    assert run(edge) == run(edge.withColumn("lang", F.when(held, F.lit("other")).otherwise(F.col("lang"))).withColumn("source", F.lit("s")))


def test_language_of_texts_without_letters(edge, nothing):
    for r in language.predict_language(edge.where("text is null or doc_id in (12, 18)")).collect():
        assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language.predict_language(nothing).count() == 0


# ---- 5

def test_licenses_of_edge_texts(edge, nothing):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(edge).collect()}
    assert len(licenses.scan_licenses(edge).collect()) == len(ROWS)
    assert tuple(got[72])[1:] == (9, 3, 3, 7, "mit", "mit", 1.0)
    assert tuple(got[75])[1:] == (8, 1, 3, 3, "apache", "apache", 1.0)
    assert tuple(got[78])[1:] == (4, 1, 0, 0, "gpl", "gpl", 1.0)
    assert tuple(got[15])[1:] == (0, 0, None, None, "", "", 0.0)
    assert licenses.scan_licenses(nothing).count() == 0


def test_every_block_that_holds_a_template_is_found(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        name = rng.choice(list(licenses.TEMPLATES))
        w = licenses.TEMPLATES[name].replace("\"", " ").split()
        keep = [x for x in w if rng.random() < rng.choice([0.7, 0.85, 0.97, 1.0])]
        rng.shuffle(keep)
        rows.append((i, rng.choice(["\n\n", "\n"]).join([sentence(rng, 10), " ".join(keep), sentence(rng, 10)])))
    import duckdb
    got = sorted(tuple(r) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "labels", "score").collect())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(f"select doc_id, labels, score from ({licenses.oracle()}) order by doc_id").fetchall()
    assert got == want and sum(bool(x[1]) for x in want) > 40


# ---- 6

def test_near_duplicates_of_edge_texts(edge, nothing):
    rows = neardup.near_duplicates(edge).collect()
    want = brute.components([(i, t) for i, t, *_ in ROWS if i is not None])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows) == Counter(
        (i, len(brute.shingles(t)), want.get(i), i is None or want[i] == i) for i, t, *_ in ROWS)
    assert neardup.near_duplicates(nothing).count() == 0


def test_links_across_a_large_group_of_loose_copies(spark):
    """Copies with many changes: most pairs of a bucket are no links, and links run between members that aren't its first."""
    rng = random.Random(9)
    rows = []
    for g in range(3):
        base = sentence(rng, 120).split()
        for _ in range(90):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows) * 2 + 1, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows)
    assert 10 < len(set(got.values())) < 260


def test_b_bit_estimate(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        w = sentence(rng, 150).split()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:130] + sentence(rng, 20).split()))]
    s = neardup.sign(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "sig")
    both = s.alias("a").join(s.alias("b"), F.expr("a.doc_id + 1 = b.doc_id and a.doc_id % 2 = 0")).select(
        F.col("a.doc_id").alias("i"), neardup.estimate(F.col("a.sig"), F.col("b.sig")).alias("x")).collect()
    text = dict(rows)
    error = [r["x"] - len(brute.shingles(text[r["i"]]) & brute.shingles(text[r["i"] + 1])) / len(
        brute.shingles(text[r["i"]]) | brute.shingles(text[r["i"] + 1])) for r in both]
    assert abs(np.mean(error)) < 0.03 and max(map(abs, error)) < 0.25


# ---- 7

def test_removed_bytes(edge, nothing):
    rows = suffix.remove_repeats(edge).collect()
    want = Counter()
    for (i, t, *_), (n, spans, kept) in zip(ROWS, brute.removed([t for _, t, *_ in ROWS])):
        want[(i, len((t or "").encode()), n, spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == want
    assert sum(1 for k in want if k[2]) > 8
    assert suffix.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_at_the_limit(spark, seed):
    """Passages of 195 to 260 bytes, cut and joined at random, over few letters and many."""
    rng = random.Random(seed)
    alphabet = ["abc ", "ab", "abcdefghij é"][seed]
    stock = ["".join(rng.choice(alphabet) for _ in range(400)) for _ in range(5)]
    texts = []
    for _ in range(60):
        out = []
        for _ in range(rng.randint(1, 4)):
            s, a = rng.choice(stock), rng.randrange(150)
            out += [s[a:a + rng.randint(195, 260)], "".join(rng.choice("xyzuvw") for _ in range(rng.randint(0, 80)))]
        texts.append("".join(out))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: (n, s, hashlib.sha256(k).hexdigest()) for i, (n, s, k) in enumerate(brute.removed(texts))}


def test_suffixes_sort_and_class_like_strings():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 4, 200):
        data = rng.integers(0, letters, 3000).astype(np.uint8)
        data[1500:2400] = data[300:1200]
        starts = rng.choice(2800, 700, replace=False)
        s = suffix.Suffixes(data, suffix.prefix_hashes(data), suffix.inverse_powers(len(data) + 1))
        raw = data.tobytes()
        assert [raw[x:x + 200] for x in s.sort(starts)] == sorted(raw[x:x + 200] for x in starts)
        heads, n = s.classes(starts)
        assert {raw[x:x + 200]: c for x, c in zip(heads, n)} == Counter(raw[x:x + 200] for x in starts)


def test_sorting_compares_only_suffixes_with_the_same_first_bytes(monkeypatch):
    data = np.random.default_rng(2).integers(97, 123, 20_200).astype(np.uint8)
    data[10_000:10_300] = data[500:800]
    s = suffix.Suffixes(data, suffix.prefix_hashes(data), suffix.inverse_powers(len(data) + 1))
    compared, less = [], suffix.Suffixes.less
    monkeypatch.setattr(suffix.Suffixes, "less", lambda self, x, *rest: compared.append(len(x)) or less(self, x, *rest))
    starts = np.arange(20_000)
    order = s.sort(starts)
    raw = data.tobytes()
    assert [raw[x:x + 200] for x in order] == sorted(raw[x:x + 200] for x in starts)
    assert 0 < sum(compared) < 2_000


def test_texts_are_searched_once_for_runs_and_extensions(edge, spark, monkeypatch):
    """What two steps read is a table; tables that no later step reads are gone when the result is read."""
    tables = {}
    monkeypatch.setattr(suffix, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    assert suffix.remove_repeats(edge).count() == len(ROWS)
    assert set(tables) == {"runs", "anchors", "repeated-anchors", "contents", "texts", "extensions", "open-texts", "strings", "places"}
    path = spark._jvm.org.apache.hadoop.fs.Path
    kept = {n for n, t in tables.items() if path(t.written_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(t.written_path))}
    assert kept == {"texts", "places"}


# ---- 8

def test_targets_and_taken(spark, edge, nothing):
    sizes = defaultdict(int)
    for _, t, _, s, _ in ROWS:
        sizes[s] += len(brute.words(t))
    want, rows = brute.targets(sizes), mixing.mix_sources(edge).collect()
    assert len(rows) == len(ROWS)
    taken = defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 5  # rounding, within rows of one hash
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_sources(edge.repartition(5)).collect()))
    assert mixing.mix_sources(nothing).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_targets_reshare_the_excess(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(rng.randint(1, 9))}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(brute.targets(sizes))


# ---- 10

def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans(spark, edge, nothing):
    rng = random.Random(12)
    letters = "a1.@-+ 0(25)x_%é4"
    texts = [t for _, t, *_ in ROWS] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["4111111111111111", "4111-1111 1111-1111-9", "+1234567", "+12345678", "0.0.0.0", "1.2.3.4.5", "a@b", "a@b.c", "🙂 a@b.c 🙂"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in df.select("doc_id", pii.listed(pii.base_spans(F.col("text"))).alias("s")).collect():
        assert r["s"] == listed(brute.base_spans(texts[r["doc_id"]])), texts[r["doc_id"]]
    assert pii.find_personal_data(edge).count() == len(ROWS)
    assert pii.find_personal_data(nothing).count() == 0


def test_patterns_take_a_megabyte(spark):
    n = 1_000_000
    texts = ["a" * n, "1" * n, "1." * (n // 2), "a@" + "b." * (n // 2), "+1" + " " * n, "a." * (n // 2), "1 " * (n // 2), "a@b" * (n // 3)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    assert df.select(F.size(pii.base_spans(F.col("text"))).alias("n")).agg(F.max("n")).first()[0] >= 0


def test_disclosing_terms_and_sanitised_texts(spark):
    rng = random.Random(13)
    rows = [(i, f"{sentence(rng, 8)}\n{sentence(rng, 5)} with Zorblax writes from z@corp.example {sentence(rng, 4)}") for i in range(6)]
    rows += [(10 + i, f"{sentence(rng, 12)} with others\nZorblaxian {sentence(rng, 9)}") for i in range(80)]
    rows += [(200, "z@corp.example alone, Zorblax"), (201, "Zorblax without the address")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal_data(df).select("doc_id", "text", "all_spans", pii.sanitise(F.col("text"), F.col("all_spans")).alias("clean")).collect()
    for r in found:
        values = {s["value"] for s in r["all_spans"]}
        for s in r["all_spans"]:
            assert r["text"][s["begin"]:s["end"]] == s["value"]
        if r["doc_id"] < 6:
            assert {"z@corp.example", "Zorblax", "writes"} <= values and "with" not in values
            assert "[EMAIL]" in r["clean"] and "[TERM]" in r["clean"] and "Zorblax" not in r["clean"]
        elif r["doc_id"] != 200:
            assert not values and r["clean"] == r["text"]
    for r in found:  # the same text, span by span
        text, at = "", 0
        for s in sorted(r["all_spans"], key=lambda s: (s["begin"], -s["end"])):
            if s["begin"] >= at:
                text += r["text"][at:s["begin"]] + pii.TAGS[s["kind"]]
                at = s["end"]
        assert r["clean"] == text + r["text"][at:]


def test_copied_documents_keep_their_disclosing_terms(spark):
    texts = [f"Zorblax writes from z@corp.example number {'abc'[k]}" for k in range(3)] * 50
    texts += [f"others go their own way {'abcdefghij'[k % 10]}" for k in range(850)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in pii.find_personal_data(df).collect():
        values = {s["value"] for s in r["all_spans"]}
        assert {"z@corp.example", "Zorblax"} <= values if r["doc_id"] < 150 else not values


def test_terms_of_rare_entities_and_neighbouring_lines(spark):
    texts = ["common words Ysolde Quennell q@corp.example common words", "common words\nOrsolya Vantongeren\n \nv@corp.example\ncommon words\nfar away Tamsin",
             "common words +49 30 1234567 Wendeline", "common +49 30 1234567 words", "Ysolde Quennell elsewhere"] + ["common words far away elsewhere"] * 400
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (None, None)], "doc_id long, text string").repartition(3)
    found = [(r["text"], {s["value"] for s in r["all_spans"] if s["kind"] == pii.TERM}) for r in pii.find_personal_data(df).collect()]
    assert len(found) == len(texts) + 2
    want = {texts[0]: {"Ysolde", "Quennell"}, texts[1]: {"Orsolya", "Vantongeren"}, texts[2]: {"Wendeline"}}
    for text, terms in found:
        assert terms == want.get(text, set()), text


def test_values_without_adjacent_digits_disclose_terms(spark):
    values = ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "+4 9 1 5 1 2 3 4", "+1(2)3(4)5(6)7(8)9"]
    texts = [f"Wendeline{'abcd'[i]} has {v} here" for i, v in enumerate(values)] + ["nobody has anything here"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: [s["value"] for s in r["all_spans"]] for r in pii.find_personal_data(df).collect()}
    assert all(found[i] == [v, f"Wendeline{'abcd'[i]}"] for i, v in enumerate(values)) and not any(found[i] for i in range(4, len(texts)))


def test_personal_data_beside_columns_of_any_name(edge):
    clash = edge.withColumns({c: F.lit(c) for c in ("_id", "_h", "_hash", "_terms", "term", "entity", "lists", "Base_Spans")})
    rows = pii.find_personal_data(clash).collect()
    assert len(rows) == len(ROWS) and all(r[c] == c for r in rows for c in ("_id", "_h", "_hash", "_terms", "term", "entity", "lists"))
    assert Counter((r["doc_id"], r["text"], str(r["all_spans"])) for r in rows) == Counter(
        (r["doc_id"], r["text"], str(r["all_spans"])) for r in pii.find_personal_data(edge).collect())


def test_disclosing_terms_against_plain_counts(spark):
    rng = random.Random(17)
    names = ["Quandor", "Velmira", "Tosk", "Ibarrow"]
    texts = []
    for i in range(120):
        who = rng.randrange(4)
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(rng.randrange(5, 90))]
        if rng.random() < .5:
            at = rng.randrange(len(words))
            words[at:at] = [names[who], rng.choice([f"mail{who}@x.example", "+49 30 1234 567", "1.2.3.4"])]
        texts.append(" ".join(words[:40]) + "\n" + " ".join(words[40:]))
    segments = []
    for t in texts:
        own = []
        for line in t.split("\n"):
            units = re.findall(r"(?:[0-9+(][0-9()+. -]*|[^ ])[^ ]* *", line)
            own += ["".join(units[i:i + pii.SEGMENT]) for i in range(0, len(units), pii.SEGMENT)]
        segments.append(own)

    def of(t):
        return set(re.findall(r"[^\W\d_][^\W\d_'-]{2,}", t))

    n, n_e, n_t, n_et = sum(map(len, segments)), Counter(), Counter(), Counter()
    for own in segments:
        found = [{s.strip()[b:e] for _, b, e in brute.base_spans(s.strip())} for s in own]
        for i, s in enumerate(own):
            n_t.update(of(s))
            for e in set().union(*found[max(i - 1, 0):i + 2]):
                n_e[e] += 1
                n_et.update((e, t) for t in of(s))
    want = {(e, t) for (e, t), k in n_et.items() if n_e[e] < n and
            math.log((n + 2) * (k + .5) / ((n_e[e] + 1) * (n_t[t] + 1))) >= .5 * math.log((n + 2) / (n_e[e] + 1))}
    got = pii.disclosing_terms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), .5)
    assert {tuple(r) for r in got.collect()} == want and any(t in names for _, t in want)


def test_one_line_of_many_addresses(spark):
    text = " ".join(f"user{i} word{i % 50}x u{i}@mail{i}.example" for i in range(20_000))
    start = time.time()
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert sum(s["kind"] == "email" for s in row["base_spans"]) == 20_000
    ends = sorted((s["begin"], s["end"]) for s in row["all_spans"])
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:])) and time.time() - start < 150


def test_license_words_scattered_over_a_block_are_no_notice(spark):
    filler = " ".join(f"w{i}" for i in range(10))
    words = licenses.TEMPLATES["cc"].replace("-", " ").replace(".", " ").split()
    rows = [(1, f" {filler} ".join(words)), (2, f"{filler} {' '.join(words)} {filler}"),
            (3, f" {filler} ".join(words) + f" {filler} " + " x ".join(words)), (4, " ".join(words[:-1]))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("", 0.0), 2: ("cc", 1.0), 3: ("cc", 1.0), 4: ("", 0.0)}
