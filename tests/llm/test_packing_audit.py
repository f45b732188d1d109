"""Packing by differencing against plain encoding, the filter audit against orders played out one by one."""

import random
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from helixscan.llm import audit, differencing, packing, tokens

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|startoftext|> y", "one two  three\n\nfour\t", "naïve œuvre – 東京", "a" * 5000]


def plain(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(path))  # as the library has it


def check(rows, docs, tokenizer, end, capacity=2048, whole=False):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    return [sum(n for _, n in x) for x in sequences.values()]


def test_pieces_are_the_librarys_ids_and_nothing_is_padded(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = differencing.pack_by_differencing(df, P.path("byte_bpe_50k.json")).collect()
    sizes = check(rows, docs, plain("byte_bpe_50k.json"), 1)
    assert all(n & (n - 1) == 0 for n in sizes)
    assert all(r["doc_tokens"] == sum(x["length"] for x in rows if x["doc_id"] == r["doc_id"]) for r in rows[:50])


def test_special_tokens_are_the_librarys_in_best_fit_packing(spark):
    docs = list(enumerate(ODD))
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), P.path("word_bpe_49k.json")).collect()
    check(rows, docs, plain("word_bpe_49k.json"), 0)
    assert [r["length"] for r in rows if r["doc_id"] == 4] == [4]


def test_long_texts_encode_in_pieces():
    table = tokens.PartTable(tokens.load_tokenizer(P.path("byte_bpe_50k.json"), special_as_text=False))
    text = "ab cd  ef\n<|endoftext|> gh " * 400
    pieces = list(tokens.segments(text, 100))
    assert len(pieces) > 50 and "".join(pieces) == text
    got = b"".join(table.ids([table.parts(x, tokens.parts_of)])[0] for x in pieces)
    assert np.frombuffer(got, "<u4").tolist() == plain("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids


def test_columns_encode_as_the_library_does_and_merge_a_word_once(monkeypatch):
    g = random.Random(5)
    gaps = [" "] * 9 + ["\n", "\n", "\t", "  ", " \n", "\x1c ", "\u00a0", "\u2003 ", "\u3000", "\x85 "]
    bits = ["ab", "Ünd", "the", "x1", "don't", "東京", "ß", "e\u0301", "...", "a,b", "<|endoftext|>", "\x00", "<|", "end%%%", "end&&&", "\U0001f600"]
    texts = [*ODD, "\nab", "ab\n", " ab", "ab ", "\n", "\t", "ab\n\ncd"]
    texts += ["".join(g.choice(bits) + (g.choice(gaps[:11] if i % 2 else gaps)) for _ in range(g.randrange(1, 30))) for i in range(600)]
    library = plain("byte_bpe_50k.json")
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokens, "LONG", 300)
    for keep in (12, 1000):
        table = tokens.ColumnTable(tokens.load_tokenizer(P.path("byte_bpe_50k.json"), special_as_text=False), keep=keep)
        for column in (pa.array(texts), pa.array(["x", *texts])[1:], pa.array(texts, pa.large_string())):
            assert [np.frombuffer(x, "<u4").tolist() for x in table.column(column)] == want
        assert table.column(pa.array([], pa.string())) == []
    table = tokens.ColumnTable(tokens.load_tokenizer(P.path("byte_bpe_50k.json"), special_as_text=False))
    merged, merge = [], table.merge
    table.merge = lambda w: merged.append(w) or merge(w)
    table.column(pa.array(["on heute on heute, on heute. on\nheute heute,;"]))
    assert sorted(merged) == sorted(["heute", "on", "Ġheute", "Ġon", ",", ".", ",;"])


def plain_differencing(sizes, k):
    """Partial partitions as full vectors of k sums."""
    parts = [sorted([n] + [0] * (k - 1), reverse=True) for n in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return parts[0]


def test_differencing_is_the_plain_one():
    g = random.Random(5)
    for k in (1, 2, 3, 7):
        for n in (1, 2, 5, 12):
            sizes = g.sample(range(1, 5000), n)
            found = differencing.differenced(sizes, k)
            assert sorted((s for s, _ in found), reverse=True) == [x for x in plain_differencing(sizes, k) if x]
            assert sorted(i for _, held in found for i in differencing.items_of(held)) == list(range(n))


def test_windows_are_near_equal_and_rise():
    g = random.Random(2)
    sizes = [min(2047, int(g.lognormvariate(6.5, 1)) + 1) for _ in range(1000)]
    found = differencing.windows(sizes, 2048)
    assert max(n for n, _ in found) <= 2048 and min(n for n, _ in found) > 1800
    assert -(-sum(sizes) // 2048) <= len(found) <= 1.06 * sum(sizes) / 2048
    assert len(differencing.windows([1500, 1500, 1500], 2048)) == 3  # two windows would do by their sum
    for many in (sizes, [1], [], [2047] * 5, [1] * 3000):
        out = differencing.filled(many, 2048)
        assert sum(n for s in out for _, _, n in s) == sum(many)
        assert all((t := sum(n for _, _, n in s)) <= 2048 and t & (t - 1) == 0 for s in out)


def test_empty_table_of_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert differencing.pack_by_differencing(empty, P.path("byte_bpe_50k.json")).collect() == []
    assert audit.filter_audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def played(docs, labels):
    """Each order's filters over whole lists of documents."""
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    fails = []
    for d, text, lang in docs:
        t = text or ""
        w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if x]
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        fails.append((lang or "", d, own))
    out = {}
    for part in {p for p, _, _ in fails}:
        mine = [(d, own) for p, d, own in fails if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(o[x] for _, o in mine) - len(gone), sum(o[x] and sum(o.values()) == 1 for _, o in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    return {k: [*v, sum(w[1] for (p, o, s), w in out.items() if p == k[0] and o[s - 1] == k[1][k[2] - 1])] for k, v in out.items()}


def test_audit_is_what_orders_give(spark):
    g = random.Random(4)
    texts = [None, "", "  \t", "A B c", "x$ y", "The word " * 60, "w " * 99, "w " * 100, " ".join(f"w{i}" for i in range(100)), " ".join(f"W{i}" for i in range(150)), "é è " * 120, " ".join(f"w{i}" for i in range(80)) + " a" * 20]
    docs = [(g.choice([None, *range(60)]), g.choice(texts), g.choice([None, "", "en", "fr"])) for _ in range(400)]
    docs += [(7, "same", "en")] * 3 + [(5, "same", "fr")] * 2 + [(None, "same", "en")] * 2 + [(i, "hot", "en") for i in range(200)]
    labels = [(i, g.choice([None, 0, 1]), g.choice([None, 0, 1])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS fails", "2 AS part", "3 AS digest", "4 AS `n`")
    found = audit.filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "9 AS text"))
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found.collect()}
    assert got == played(docs, labels)
    assert len(found.columns) == 10


def test_long_text_is_cut_into_words_by_parts(monkeypatch):
    text = b"ab cd\tef\n" * 300 + b"long" * 100
    want = audit.word_counts(text)
    monkeypatch.setattr(audit, "PART", 64)
    assert audit.word_counts(text) == want == (901, 4)


def test_potentials_give_shapley_values():
    g = np.random.default_rng(1)
    counts = g.integers(0, 50, 32)
    v = audit.removed(counts)
    p = audit.potentials(v)
    for i in range(5):
        gone = sum(int(v[before | 1 << i] - v[before]) for o in permutations(range(5)) for before in [sum(1 << x for x in o[: o.index(i)])])
        assert p[31] - p[31 ^ 1 << i] == gone
