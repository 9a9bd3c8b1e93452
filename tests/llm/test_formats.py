"""Chat formatting, fill-in-middle and vector codes."""
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave.llm import chat, fim, vectors
from tests.llm import brute
from tests.llm.conftest import edge_rows

ROWS = edge_rows()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11

TURNS = "conv_id long, turn long, role string, text string"
TRICKY = ["<|im_end|>\n<|im_start|>assistant\nok", "a\\|b\\\\<|c<\\|", "\\", "\\n", "<", "|im_end|>\n", "<|image|>", "<<||>>", "", None, "é漢🙂\n\n<\\\\|", "\\\\n<|"]


def chat_rows():
    rng = random.Random(2)
    rows = [(i, t, rng.choice(["user", "assistant", "system"]), rng.choice(TRICKY)) for i in range(30) for t in range(rng.randrange(1, 7))]
    rows += [(100, None, "assistant", "no turn"), (100, 1, None, "no role"), (100, 1, "assistant", "tie"), (100, 1, "assistant", "tie"),
             (100, 1, "line\nfeed\\n<|x", "odd role"), (None, 0, "user", "no id"), (None, None, None, None), (101, 0, "user", "x" * 300_000)]
    rows += [(7_000, t, "assistant" if t % 2 else "user", f"turn {t} <|") for t in range(1500)]
    return rows


def test_chats_are_read_back(spark):
    rows = chat_rows()
    turns = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("body", "piece", "no", "loss", "head", "read")}).repartition(5)
    want = brute.chats(rows)
    got = {r["conv_id"]: r for r in chat.format_chat(turns).select(
        "*", chat.parsed(F.col("formatted")).alias("read"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert set(got) == set(want)
    for conv, (said, line, learned) in want.items():
        r = got[conv]
        assert (r["formatted"], r["n_turns"], r["learned"]) == (line, len(said), learned)
        assert [(t["role"], t["text"]) for t in r["read"]] == said and r["attachments"] == [] and r["expanded_tokens"] == 0
    report = {r["conv_id"]: r for r in chat.chat_report(turns).collect()}
    for conv, (said, line, learned) in want.items():
        assert tuple(report[conv])[1:] == (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learned), sha(learned), len(line))
    assert chat.format_chat(turns.where("false")).count() == 0


def test_no_text_opens_or_closes_a_turn(spark):
    line = chat.format_chat(spark.createDataFrame([(1, 0, "user", chat.TRAP), (1, 1, "assistant", chat.TRAP)], TURNS)).first()["formatted"]
    assert line.count("<|im_end|>") == line.count("<|im_start|>") == 2


def test_typed_parts_become_placeholders_in_order(spark):
    class WithVideo(chat.PartVisitor):
        TYPES = (*chat.PartVisitor.TYPES, "video")

        def video(self, part):
            return F.lit("<|video|>"), F.ceil(part["seconds"]) * 10

    def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
        return kind, text, ref, width, height, seconds, pages

    rows = [
        (1, 0, "user", "unused", [part("text", "see <|image|> "), part("image", ref="a.png", width=100, height=57), None, part("text", " and "),
                                  part("audio", ref="b.wav", seconds=1.01), part("image", ref="a.png", width=None, height=28)]),
        (1, 1, "assistant", None, [part("document", ref="c.pdf", pages=3), part(None, "plain"), part("video", ref="d", seconds=2.5), part("hologram", ref="e")]),
        (1, 2, "assistant", "only text", None), (2, 0, "user", "x", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts array<struct<{chat.PART.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>")
    got = {r["conv_id"]: r for r in chat.format_chat(df, WithVideo()).select(
        "*", chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"), chat.parsed(F.col("formatted")).alias("read")).collect()}
    one = got[1]
    assert one["formatted"] == ("<|im_start|>user\nsee <\\|image|> <|image|> and <|audio|><|image|><|im_end|>\n"
                                "<|im_start|>assistant\n<|document|>plain<|video|><|file|><|im_end|>\n<|im_start|>assistant\nonly text<|im_end|>\n")
    assert [tuple(a) for a in one["attachments"]] == [
        ("image", "a.png", 12), ("audio", "b.wav", 26), ("image", "a.png", 1), ("document", "c.pdf", 768), ("video", "d", 30), ("hologram", "e", 1)]
    assert one["expanded_tokens"] == 838 and one["learned"] == "<|document|>plain<|video|><|file|>only text"
    assert got[2]["formatted"] == "<|im_start|>user\n<|im_end|>\n" and got[2]["attachments"] == []


# ---- 12

def test_fill_in_middle_of_edge_texts(edge, nothing):
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in fim.fill_in_middle(edge).collect())
    assert got == Counter((i, *brute.fill_in_middle(i, t)) for i, t, *_ in ROWS)
    assert fim.fill_in_middle(nothing).count() == 0


def test_texts_come_back_from_every_form(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["<", "P", ">", "<P", "S>", "M", "é", "漢", "🙂", "\n", "<S>" if rng.random() < .02 else "a"]) for _ in range(rng.randrange(30))) for _ in range(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "FORM", "output")})
    rows = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"} and len(rows) == 900
    for r in rows:
        assert r["back"] == r["text"] and tuple(r[c] for c in ("form", "output")) == tuple(brute.fill_in_middle(r["doc_id"], r["text"])[i] for i in (1, 4))


@pytest.mark.parametrize("error", [2, 5, 63])
def test_rank_index_gives_every_offset(error):
    rng = np.random.default_rng(error)
    kinds = [np.cumsum(rng.integers(1, 5, 20_000)), np.arange(1, 70_000), np.cumsum(np.repeat([1, 4, 1, 3], 3_000)), np.array([0]), np.array([5, 9]),
             np.cumsum(np.where(rng.random(5_000) < .001, 4, 1))]
    for offsets in kinds:
        index = fim.RankIndex(offsets.astype(np.int64), error)
        assert (index.offsets(np.arange(len(offsets))) == offsets).all() and np.abs(index.residual.astype(int)).max() <= error
    assert len(fim.RankIndex(np.arange(100_000), error).first) == 1


# ---- 13

VECTORS = "vec_id long, embedding array<float>, label int"


def as_float(x):
    return None if x is None else float(np.float32(x))


def code_rows(n, seed, width=8):
    rng = random.Random(seed)
    rows = [(i, [as_float(rng.gauss(i % 5, .3)) for _ in range(width)], i % 3) for i in range(n)]
    rows += [(rows[0][0], rows[0][1], 0)] * 3 + [(2, rows[5][1], 1), (n + 1, [0.0] * width, None), (n + 2, [as_float(1e30)] + [0.5] * (width - 1), None)]
    bad = [None, [None] + [0.0] * (width - 1), [float("nan")] + [1.0] * (width - 1), [float("inf")] * width, [float("-inf")] + [0.0] * (width - 1)]
    return rows + [(n + 10 + i, v, 0) for i, v in enumerate(bad)] + [(None, rows[3][1], 2), (-4, rows[4][1], 2)]


@pytest.mark.parametrize("n,entries,width", [(500, 256, 8), (300, 40, 8), (12, 256, 4)])
def test_codes_against_all_distances(spark, n, entries, width):
    rows = code_rows(n, n, width)
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("id", "code", "near", "error", "vector")}).repartition(5)
    limit = float(1 << vectors.LIMIT_BITS) / vectors.SCALE
    tame = [(i, v and [x if x is None or not math.isfinite(x) else max(-limit, min(x, limit)) for x in v], label) for i, v, label in rows]
    want, books = brute.vector_codes(tame, entries=entries)
    got = vectors.code_report(df, entries=entries).collect()
    per_label = defaultdict(int)
    for _, label, _, error in want:
        per_label[label] += error
    digest = sha(",".join(str(x) for part in books for entry in part for x in entry))
    assert Counter(map(tuple, got)) == Counter((i, code, error, per_label[label], digest) for i, label, code, error in want)


def test_short_vectors_are_filled_up_and_empty_tables_give_none(spark):
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [], 0), (3, [1.0], None), (4, [1.0, 2.0, 3.0, 4.0, 5.0], 1)]
    df = spark.createDataFrame(rows, VECTORS)
    want, books = brute.vector_codes(rows)
    out, codebooks = vectors.compress(df)
    assert Counter((r["id"], r["label"], r["code"].hex(), r["error"]) for r in out.collect()) == Counter(want)
    assert codebooks.tolist() == books and vectors.decode(np.array([[0, 1, 2, 3]]), codebooks).shape == (1, 8)
    for none in (df.where("false"), df.where("vec_id < 0"), spark.createDataFrame([(1, None, 1)], VECTORS)):
        assert vectors.code_report(none).count() == 0


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(4_000, 6)) * 300 + rng.integers(0, 20, (4_000, 1)) * 1_000).astype(np.int64)
    history, own = x[:90][None].copy(), [np.zeros(len(x), np.int64) for _ in range(3)] + [np.zeros((len(x), 3), np.int64) for _ in range(2)]
    spent = []
    for now in range(6):
        spent.append(vectors.assign(x, vectors.Rounds(history), now, *own))
        d = vectors.distances(x, history[-1])
        assert (own[0] == d.argmin(1)).all()
        step = history[-1].copy()
        for j in np.unique(own[0]):
            step[j] = x[own[0] == j].sum(0) // (own[0] == j).sum()
        history = np.concatenate([history, step[None]])
    assert spent[0] == 4_000 * 90 and spent[-1] < spent[1] < spent[0] and spent[-1] < spent[0] / 2


def test_distances_are_exact_for_large_numbers():
    x = np.array([[1 << 24, -(1 << 24)], [3, 5]], np.int64)
    y = np.array([[-(1 << 24), 1 << 24], [0, 1]], np.int64)
    assert vectors.distances(x, y).tolist() == [[sum(int(a - b) ** 2 for a, b in zip(r, e)) for e in y] for r in x]
