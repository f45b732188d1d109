"""Tokenizers, packing, media, language model and language identification against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from helixscan.llm import gif, langid, packing, ppm, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a   b", "a \n b", "  ", "\n", "a\n b", "a\t b  \n\n c", "<|endoftext|> hi", "日本語 テキスト  x", "é ́ ß", "don't  we'll", "\x1c \x1da \x85 b", "🙂 🙂🙂", "x" * 30000, "word " * 9000, "İI ŉ ﬁ"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, odd, long and repeated texts, and columns whose names clash."""
    rows = [(i, t, None if i % 3 else "en", "s", i, "score", "held") for i, t in enumerate(ODD)]
    rows += rows[2:5] + [(None, "no id", "en", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, _text string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def tiktoken_encoding():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_tiktoken(spark, docs, odd):
    enc = tiktoken_encoding()
    g = random.Random(1)
    mixed = [(i, "".join(g.choice("ab \n\t'st1.,é 　") for _ in range(30))) for i in range(2000)]
    frames = [docs.select("doc_id", "text"), odd.select("doc_id", "text"), spark.createDataFrame(mixed, "doc_id long, text string")]
    for df in frames:
        texts = {}
        for r in df.collect():
            texts.setdefault(r["doc_id"], r["text"] or "")
        found = tokens.bpe_round_trip(df, JSON, RANKS).collect()
        assert len(found) == df.count()
        for r in found:
            ids = enc.encode_ordinary(texts[r["doc_id"]])
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert tokens.bpe_round_trip(docs.limit(0), JSON, RANKS).count() == 0


def test_offsets_and_split_characters():
    bpe = tokens.byte_bpe(JSON, RANKS)
    text = "aé日🙂x word"
    ids, offsets = bpe.encode_with_offsets(text)
    assert "".join(bpe.decode_stream(ids)) == text and bpe.decode(ids).decode() == text
    assert offsets[0][0] == 0 and offsets[-1][1] == len(text) and all(a < b for a, b in offsets)
    assert list(bpe.decode_stream(ids[:-4]))[-1] == text[: len("".join(bpe.decode_stream(ids[:-4])))][-1]


def test_part_table_forgets_but_stays_right():
    table = tokens.PartTable(tokens.load_tokenizer(WORDS), lower=True, keep=8)
    whole = tokens.load_tokenizer(WORDS)
    for t in ("The quick brown fox", "jumps over, the lazy dog.", "THE quick É été 12 x3"):
        assert np.frombuffer(table.ids([t.split(" ")])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
        assert len(table.newer) <= 8


def check_packing(found, texts, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)  # as the library has it, special tokens included
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, copies in texts.items():
        ids = [*whole.encode(copies[0], add_special_tokens=False).ids, 0]
        want = collections.Counter((k, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), capacity)))
        assert collections.Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc]) == collections.Counter({k: v * len(copies) for k, v in want.items()})
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in found)
    return len(sequences), -(-total // capacity)


def by_id(df):
    texts = collections.defaultdict(list)
    for r in df.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    return texts


def test_packing_loses_nothing(docs, odd, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 7)  # many salted groups
    found = packing.pack_documents(docs, WORDS).collect()
    used, least = check_packing(found, by_id(docs), 2048)
    assert used <= least + 1
    check_packing(packing.pack_documents(odd, WORDS).collect(), by_id(odd), 2048)
    check_packing(packing.pack_documents(odd, WORDS, capacity=16).collect(), by_id(odd), 16)
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("lengths, most", [([1024] * 9, 5), ([2048] * 3 + [1], 4), ([1000, 1048, 700, 700, 648, 500, 548, 1000], 3), ([1] * 5000, 3), (list(range(1, 1500)), 549)])
def test_plans(lengths, most):
    counts = collections.Counter(lengths)
    found = packing.plan(counts)
    used = collections.Counter()
    for held, n in found:
        assert sum(k * m for k, m in held.items()) <= 2048
        for k, m in held.items():
            used[k] += m * n
    assert used == counts and sum(n for _, n in found) <= most


def test_gif_round_trip(docs, odd):
    for df in (docs, odd):
        texts = by_id(df)
        found = gif.frame_columns(gif.gif_column(df)).collect()
        assert len(found) == df.count()
        for r in found:
            data = texts[r["doc_id"]][0].encode()
            payload = data + bytes(max(1, -(-len(data) // 64)) * 64 - len(data))
            assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert gif.frame_columns(gif.gif_column(docs.limit(0))).count() == 0


def test_long_random_streams():
    g = random.Random(4)
    for data in (g.randbytes(150_000), b"\0" * 200_000, bytes(range(256)) * 500, b"ab" * 50_000):
        assert gif.lzw_decode(gif.lzw_encode(data), 8) == data


def packed(codes, size):
    """Codes of a stream that is cleared by its clear codes alone."""
    bits = at = used = 0
    for c in codes:
        width = 12 if used >= gif.FULL else int(gif.widths(size, gif.FULL)[used])
        bits |= c << at
        at, used = at + width, 0 if c == 1 << size else used + 1
    return bits.to_bytes((at + 7) // 8, "little")


def plain_decode(stream, size):
    """Code by code, bit by bit."""
    clear, bits, at, out = 1 << size, int.from_bytes(stream, "little"), 0, []
    table, prev, used = [bytes([i]) for i in range(clear)] + [b"", b""], None, 0
    while at + (width := 12 if used >= gif.FULL else int(gif.schedule(size)[0][used])) <= 8 * len(stream):
        c, at, used = bits >> at & (1 << width) - 1, at + width, used + 1
        if c == clear + 1:
            break
        if c == clear:
            table, prev, used = table[: clear + 2], None, 0
            continue
        if c > len(table) or prev is None and c >= clear:
            raise ValueError
        entry = table[c] if c < len(table) else prev + prev[:1]
        if prev is not None and len(table) < gif.FULL:
            table.append(prev + entry[:1])
        out.append(entry)
        prev = entry
    return b"".join(out)


def plain_codes(data, size, g, cleared):
    """Greedy codes, or now and then shorter ones; a full table stays as it is, or is cleared."""
    clear, codes, i = 1 << size, [1 << size], 0
    start = {bytes([k]): k for k in range(clear)}
    table, free, last = dict(start), clear + 2, b""
    while i < len(data):
        n = 1
        while i + n < len(data) and data[i : i + n + 1] in table and g.random() < 0.99:
            n += 1
        codes.append(table[data[i : i + n]])
        if last and free < gif.FULL:
            table.setdefault(last + data[i : i + 1], free)
            free += 1
        last, i = data[i : i + n], i + n
        if cleared and g.random() < 0.001:
            codes.append(clear)
            table, free, last = dict(start), clear + 2, b""
    return [*codes, clear + 1]


def test_codes_are_read_as_one_by_one():
    g = random.Random(8)
    good = bad = 0
    for k in range(160):
        size = g.choice([2, 3, 5, 8])
        data = bytes(g.choices(range(min(1 << size, g.choice([1, 3, 256]))), k=g.choice([0, 1, 2, 5, 300, 3000, 9000 if k % 10 == 1 else 900])))
        stream = packed(plain_codes(data, size, g, k % 2), size) if k % 4 else packed([1 << size, *(g.randrange(1 << size) + (g.random() < 0.3) * g.randrange(k + 1) for _ in range(60))], size)
        if k % 4:
            assert gif.lzw_decode(stream, size) == data
        for x in (stream, stream[: g.randrange(len(stream)) + 1], bytes(b ^ (g.random() < 0.002) * g.randrange(256) for b in stream)):
            try:
                want = plain_decode(x, size)
            except ValueError:
                bad += 1
                with pytest.raises(ValueError):
                    gif.lzw_decode(x, size)
            else:
                good += 1
                assert gif.lzw_decode(x, size) == want
    assert good > 100 and bad > 20


def test_reading_takes_less_than_code_by_code():
    """Against the steps that code by code takes at least: an entry looked up, made and kept."""
    import time

    g = random.Random(3)
    words = ["".join(g.choices("abcdefghijklmnop", k=g.randrange(1, 9))) for _ in range(400)]
    stream = gif.lzw_encode(" ".join(g.choices(words, k=4000)).encode()[: 64 * 256])
    codes = [g.randrange(256) for _ in range(len(stream) * 8 // 12)]

    def steps():
        table, out, prev = [bytes([i]) for i in range(256)], [], b""
        for c in codes:
            entry = table[c] if c < len(table) else prev + prev[:1]
            if len(table) < gif.FULL:
                table.append(prev + entry[:1])
            out.append(entry)
            prev = entry
        return b"".join(out)

    def least(f):
        took = []
        for _ in range(15):
            t = time.process_time()
            f()
            took.append(time.process_time() - t)
        return min(took)

    assert least(lambda: gif.lzw_decode(stream, 8)) < least(steps)


def image(index, w, h, left=0, top=0, disposal=1, clear=None, palette=None, interlaced=False, delay=5):
    control = b"!\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0]) + b"\0"
    flags = (0x80 | 7 if palette is not None else 0) | (0x40 if interlaced else 0)
    head = b"," + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([flags]) + (palette.tobytes() if palette is not None else b"")
    return control + head + b"\x08" + gif.blocks(gif.lzw_encode(bytes(index)))


def test_disposal_transparency_palettes_and_interlacing():
    red = np.zeros((256, 3), np.uint8)
    red[:, 0] = np.arange(256)
    data = b"GIF89a" + b"\x02\0\x02\0" + b"\xf7\0\0" + gif.GREY.tobytes()
    data += image([10, 20, 30, 40], 2, 2)
    data += image([99, 7], 2, 1, top=1, clear=99, disposal=3)  # left pixel shows through; goes away afterwards
    data += image([200], 1, 1, palette=red, disposal=2)  # local palette; its area is cleared afterwards
    data += image([1, 2], 1, 2, left=1) + b";"
    shown = [f.shown[..., 0].tolist() for f in gif.read_gif(data)]
    assert shown == [[[10, 20], [30, 40]], [[10, 20], [30, 7]], [[200, 20], [30, 40]], [[0, 1], [30, 2]]]
    assert gif.read_gif(data)[2].shown[0, 0].tolist() == [200, 0, 0] and gif.read_gif(data)[0].delay_ms == 50
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    tall = b"GIF89a" + b"\x01\0\x09\0" + b"\xf7\0\0" + gif.GREY.tobytes() + image(rows, 1, 9, interlaced=True) + b";"
    assert gif.read_gif(tall)[0].samples.ravel().tolist() == list(range(9))
    with pytest.raises(ValueError):
        gif.read_gif(b"PNG")


def plain_feature(data):
    """Frames, time and histogram of a payload, pixel by pixel."""
    height = min(len(data) // 64, 256)
    canvas, counts, frames = [(0, 0, 0)] * (64 * height), [0] * 24, 0
    for at in range(0, len(data), 64 * 256):
        for i, b in enumerate(data[at : at + 64 * 256]):
            canvas[i] = ((b >> 5) * 255 // 7, (b >> 2 & 7) * 255 // 7, (b & 3) * 85)
        frames += 1
        for colour, n in collections.Counter(canvas).items():
            for c in range(3):
                counts[8 * c + colour[c] // 32] += n
    return f"{frames}:{100 * frames}:{','.join(map(str, counts))}"


def test_gif_features(spark):
    texts = by_id(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in gif.op8_gif_media(spark, SF).collect():
        assert r["feature"] == plain_feature(gif.padded((texts[r["doc_id"]][0] or "").encode()))


def test_damaged_files_are_null(spark):
    whole = gif.write_gif(bytes(range(256)) * 300)
    header = b"GIF89a" + b"\xff\xff\xff\xff" + b"\0\0\0"
    at = 13 + 768 + 8 + 10  # the first frame's code size
    bad = [None, b"", b"GIF89a", header, header + b";", whole[:-200], whole[:-1], whole[:700], whole[:at] + b"\xff" + whole[at + 1 :], whole[:at] + b"\x01" + whole[at + 1 :]]
    bad += [whole[: at + 2] + b"\xff" * 200 + whole[at + 202 :], b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\xff\xff\xff\xff\0\x08\0;"]
    rows = [(i, x, "other") for i, x in enumerate(bad + [whole, whole])]
    found = {r["n"]: r for r in gif.frame_columns(spark.createDataFrame(rows, "n int, media binary, frames string")).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["frames"] is None and found[i]["payload_sha256"] is None for i in range(len(bad)))
    assert found[len(bad)]["payload_bytes"] == 256 * 300 and len(found[len(bad)]["frames"]) == 5
    g = random.Random(7)
    small = gif.write_gif(b"abcdefgh" * 40)
    for _ in range(3000):  # any damage is an error or a reading, nothing else
        x = bytearray(small)
        for _ in range(g.randrange(1, 4)):
            x[g.randrange(len(x))] = g.randrange(256)
        try:
            gif.read_gif(bytes(x[: g.randrange(len(x))] if g.random() < 0.3 else x))
        except ValueError:
            pass


def brute_ppm(train, order=4):
    count = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in train:
        x = b"\xff" * order + t + b"\xff"
        for p in range(order, len(x)):
            for k in range(order + 1):
                count[k][x[p - k : p]][x[p]] += 1

    def score(t):
        x, total = b"\xff" * order + t + b"\xff", 0.0
        for p in range(order, len(x)):
            k = 0
            while k < order and x[p - k - 1 : p] in count[k + 1]:
                k += 1
            known, left = set(), 1.0
            for j in range(k, -1, -1):
                c = {s: n for s, n in count[j][x[p - j : p]].items() if s not in known}
                n, d = sum(c.values()), len(c)
                d = 0 if len(known) + d == 256 else d
                if x[p] in c:
                    total += math.log10(left * c[x[p]] / (n + d))
                    break
                left *= d / (n + d) if n else 1
                known |= set(c)
            else:
                total += math.log10(left / (256 - len(known)))
        return total

    return score


def held_out(df):
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))


@pytest.mark.parametrize("hot", [3, 1000])
def test_ppm_and_base_scores(spark, docs, odd, monkeypatch, hot):
    monkeypatch.setattr(ppm, "HOT_WORDS", hot)
    monkeypatch.setattr(ppm, "HOT_CONTEXTS", 300)
    df = docs.select("doc_id", "text").limit(60).union(odd.select("doc_id", "text").where("doc_id is null or doc_id > 3 and length(text) < 100 or doc_id = 15")).union(spark.createDataFrame([(900, None), (901, "")], "doc_id long, text string"))
    df = spark.createDataFrame(df.collect(), df.schema)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
    out_of = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if not out_of(i)]
    count = collections.Counter(w for t in train for w in t.lower().split())
    count["end"] = len(train)
    n, v = sum(count.values()), len(count)
    score = brute_ppm(train)
    want = collections.Counter()
    for i, t in rows:
        words = [*t.lower().split(), "end"]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        want[i, out_of(i), len(words), sum(count[w] > 0 for w in words), n, round(base, 4), round(score(t), 1)] += 1
    found = collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 1)) for r in ppm.language_model_scores(df, held_out(df)).collect())
    different = [x for x in (want - found) if not any(x[:5] == y[:5] and abs(x[5] - y[5]) < 2e-4 and abs(x[6] - y[6]) < 0.2 for y in (found - want))]
    assert not different and sum(want.values()) == sum(found.values())


def test_ppm_keeps_all_contexts(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(ppm, "HOT_CONTEXTS", 50, raising=False)
    rows = docs.select("doc_id", "text").limit(40).union(odd.where("doc_id > 3 and length(text) < 100").selectExpr("doc_id + 100000", "text").distinct()).collect()
    df = spark.createDataFrame([*rows, (200000, None), (200001, "")], "doc_id long, text string")
    train = [(r["text"] or "").encode() for r in df.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    score = brute_ppm(train)
    found = ppm.language_model_scores(df, held_out(df)).collect()
    assert len(found) == df.count()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
    assert max(abs(r["score"] - score(texts[r["doc_id"]])) / (1 - r["score"]) for r in found) < 1e-5


def test_long_word_of_all_documents_is_no_hot_key(spark, monkeypatch):
    """It goes to the tasks; other long words are joined by shuffle."""
    from pyspark.sql import functions as F

    boiler, other = "b" * 100, "o" * 90
    texts = [f"{boiler} word{i % 7} {boiler if i % 2 else other + str(i)}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    counts = collections.Counter(w for i, t in enumerate(texts) if i % 5 for w in [*t.split(), ""])
    n, v = sum(counts.values()), len(counts)
    joins = []
    joined = ppm.joined_by_key
    monkeypatch.setattr(ppm, "joined_by_key", lambda left, right, keys: joins.append(right.count()) or joined(left, right, keys))
    for r in ppm.language_model_scores(df, F.col("doc_id") % 5 == 0).collect():
        words = [*texts[r["doc_id"]].split(), ""]
        assert r["n_known"] == sum(counts[w] > 0 for w in words) and r["train_tokens"] == n
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)) < 1e-6
    assert joins == [sum(len(w) > ppm.HOT_BYTES for w in counts)] and joins[0] > 100


def test_ppm_without_rows(docs):
    assert ppm.language_model_scores(docs.limit(0), held_out(docs)).count() == 0


def test_language_model_tells_text_from_noise(spark, docs):
    g = random.Random(2)
    noise = spark.createDataFrame([(10**6 + i, "".join(g.choice("qxzjvkw") for _ in range(200))) for i in range(5)], "doc_id long, text string")
    texts = docs.select("doc_id", "text").union(noise)
    from pyspark.sql import functions as F

    found = ppm.language_model_scores(texts, F.col("doc_id") >= 10**6).collect()
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in texts.collect()}
    rate = {r["doc_id"]: -r["score"] / size[r["doc_id"]] for r in found}
    assert min(rate[10**6 + i] for i in range(5)) > 2 * np.median([v for k, v in rate.items() if k < 10**6])


def test_language_id(spark, odd):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.train(langid.training_rows(rows.where(~out)))
    judged = langid.predicted(rows.where(out), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in judged]) > 0.97
    strange = langid.predicted(odd, model)
    assert strange.columns == ["doc_id", "text", "lang", "source", "n_chars", "_text", "lang_pred", "score"]
    for r in strange.collect():
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    assert strange.count() == odd.count() and langid.predicted(odd.limit(0), model).count() == 0
    assert langid.train(langid.training_rows(rows.limit(0))) is None
    assert {r["lang_pred"] for r in langid.predicted(odd, None).collect()} == {"und"}


def test_language_id_takes_all_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_EACH", 5)
    rows = [(None if k == 0 else 100 * k + i, f"l{k:02}", f"text {k} {i}") for k in range(90) for i in range(3 if k else 40)]
    found = langid.training_rows(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    each = collections.Counter(lang for lang, _ in found)
    assert set(each) == {f"l{k:02}" for k in range(90)} and set(each.values()) == {3, 5}


def test_training_rows_are_spread_over_rows_and_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(langid, "ROWS_EACH", 40)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"), F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(" "), F.array_join(F.sequence(F.lit(1000), F.lit(1999)), " ")).alias("text"))
    found = langid.training_rows(df)
    assert collections.Counter(lang for lang, _ in found) == {"a": 40 * langid.PARTS, "b": 40 * langid.PARTS}
    assert {len(t) for _, t in found} == {langid.CHARS}
    first = [int(t.split()[2]) for _, t in found]
    assert 1350 < np.mean(first) < 1550 and min(first) < 1100 and max(first) > 1800  # places are spread over the whole text
    least = df.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(langid.FINE))).where("lang = 'a'").orderBy("h").limit(40)
    assert sorted(langid.training_rows(least)) == [x for x in found if x[0] == "a"]


def test_network_is_the_plain_one():
    """Embedding, filters, maximum, layer and softmax, position by position."""
    g = np.random.default_rng(5)
    net = langid.ByteConvNet(["a", "b", "c"], seed=9)
    net.bias[:] = g.normal(0, 0.2, len(net.bias))
    x = g.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    for row, p in zip(x, net.tables().probabilities(x), strict=True):
        pooled = []
        for w, f in net.filters.items():
            values = [[sum(float(net.embed[row[at + k]] @ f[k][:, j]) for k in range(w)) for j in range(langid.FILTERS)] for at in range(langid.WINDOW - w + 1)]
            pooled += [max(v[j] for v in values) for j in range(langid.FILTERS)]
        hidden = np.maximum(np.array(pooled) + net.bias, 0)
        e = np.exp(hidden @ net.dense + net.offset)
        assert np.allclose(p, e / e.sum(), atol=1e-4)


def test_gradients_are_slopes():
    g = np.random.default_rng(1)
    net = langid.ByteConvNet(["a", "b"], seed=3)
    x, y = g.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        t = net.tables()
        return -np.log(t.probabilities(x)[np.arange(4), y]).mean()

    for p, d in zip(net.parameters(), net.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - d[at]) < 0.1 * abs(d[at]) + 1e-3
