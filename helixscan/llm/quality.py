"""Quality rules by distribution divergence, with DataFrame functions only.

Every language has a reference: the histogram of character classes and the histogram of its most
frequent words (lower-cased runs of letters), counted over all documents.  A document is compared with the reference of its own
language, then with all; it is kept if for some language both Jensen-Shannon distances are small enough.  Texts too short for a histogram
to mean anything are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, named, restored, set_aside, unlike, written

SPACE = r"[ \t-\r]+"
#: What stands between the words that are counted.
APART = r"[^\p{L}]+"
#: Model size: frequent words of each language.
WORDS = 40
#: Distances (0 to 1) up to which a document is like its language, the least characters and words to judge by,
#: and what is added for a short text (over the root of its length).
MOST_CHARS, MOST_WORDS, LEAST_CHARS, LEAST_WORDS = 0.14, 0.34, 200, 40
SPREAD_CHARS, SPREAD_WORDS = 0.8, 1.0
#: Character classes: small letters and digits (so that a number or a key in prose does not count
#: against it), capital letters, blanks, stops, bars and brackets, symbols, others.
CLASSES = 7
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "like_language", "char_distance", "word_distance", "kept")


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    Words are runs of characters other than ASCII white space.  A null text has no words."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    out = docs.withColumns({"_words": words, "_lines": lines})
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        # Small letters and blanks, most of a text, go first; symbols are counted in the rest.
        "n_symbols": F.length(F.regexp_replace(F.regexp_replace(text, r"[a-z \t-\r]+", ""), r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        # A hash for the window that begins at each word but the last two: where all differ, no window occurs twice.
        "_hashes": F.when(F.size("_words") >= 3, F.slice(F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))), F.lit(1), F.size("_words") - 2)),
    })
    # Windows with equal hashes stand side by side once sorted; a start covers three words, or fewer up to the next start.
    placed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_placed", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), placed))

    def repeats(x: Column, k: Column) -> Column:
        """Whether the window ``x`` is that of place ``k``: equal hashes, and then equal words."""
        y = F.get("_placed", k)
        same = [F.get("_words", x["i"] + j) == F.get("_words", y["i"] + j) for j in range(3)]
        return F.coalesce((x["h"] == y["h"]) & same[0] & same[1] & same[2], F.lit(False))

    starts = F.sort_array(F.transform(F.filter("_placed", lambda x, k: repeats(x, k - 1) | repeats(x, k + 1)), lambda x: x["i"]))
    out = out.withColumn("_starts", starts)
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_lines", "_hashes", "_placed", "_starts")


def most_frequent(counts: DataFrame) -> DataFrame:
    """The ``WORDS`` most frequent words of each language; ``counts``: ``lang, word, n``.  Ties go by the word."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= WORDS).drop("_rank")


def vocabulary(docs: DataFrame) -> list[str]:
    """The most frequent words of every label, over all documents: at most ``WORDS`` for each language."""
    words = docs.where("lang is not null and text is not null").select("lang", F.explode(F.split(F.lower("text"), APART)).alias("word"))
    top = most_frequent(words.where("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n")))
    return sorted(r["word"] for r in top.select("word").distinct().collect())


def profiles(docs: DataFrame, words: list[str]) -> DataFrame:
    """Adds ``_chars`` (counts by character class), ``_tokens`` (the number of words of letters) and
    ``_bins`` (each of ``words`` that occurs, with its count) to rows with ``word_chars``."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumns({"_n": F.length(text), "_rest": F.regexp_replace(text, r"[a-z \t-\r]+", "")})
    # ASCII small letters and blanks go first; the other classes are counted in the short rest.
    count = lambda pattern: F.length("_rest") - F.length(F.regexp_replace("_rest", pattern, ""))
    classes = {
        "upper": r"\p{Lu}+", "small": r"\p{Ll}+", "digit": r"[0-9]+", "stop": r"[.,;:'\"()?-]+", "bar": r"[|/\\<>{}\[\]=]+", "symbol": r"[#*$%&!@^_+~`]+",
    }
    out = out.withColumns({f"_c_{k}": count(v) for k, v in classes.items()})
    known = sum((F.col(f"_c_{k}") for k in classes), F.lit(0))
    plain = F.col("word_chars") - F.length("_rest") + F.col("_c_small") + F.col("_c_digit")
    counts = [plain, F.col("_c_upper"), F.col("_n") - F.col("word_chars"), F.col("_c_stop"), F.col("_c_bar"), F.col("_c_symbol"), F.length("_rest") - known]
    out = out.withColumn("_chars", F.array(*[x.cast("double") for x in counts])).drop("_n", "_rest", *[f"_c_{k}" for k in classes])
    out = out.withColumn("_list", F.array_remove(F.split(F.lower(text), APART), ""))
    out = out.withColumn("_common", F.sort_array(F.filter("_list", lambda w: w.isin(words))))
    out = out.withColumn("_seen", F.array_distinct("_common"))
    # Equal words stand side by side: one begins where it is found first and ends where the next begins.
    out = out.withColumn("_firsts", F.transform("_seen", lambda w: F.array_position("_common", w)))
    n = lambda i: F.coalesce(F.get("_firsts", i + 1), F.size("_common") + 1) - F.get("_firsts", i)
    bins = F.transform("_seen", lambda w, i: F.struct(w.alias("w"), n(i).cast("double").alias("n")))
    return out.withColumns({"_tokens": F.size("_list").cast("double"), "_bins": bins}).drop("_list", "_seen", "_common", "_firsts")


def references(profiled: DataFrame) -> DataFrame:
    """One row ``refs``: for every language the shares of the classes, its most frequent words, their
    shares, and the sum of these.  A few dozen numbers for each label that occurs."""
    own = profiled.where("lang is not null")
    sums = own.groupBy("lang").agg(F.array(*[F.sum(F.get("_chars", F.lit(i))) for i in range(CLASSES)]).alias("chars"), F.sum("_tokens").alias("tokens"))
    total = F.aggregate("chars", F.lit(0.0), lambda s, x: s + x)
    sums = sums.withColumn("total", total).where("total > 0 and tokens > 0")
    counts = own.select("lang", F.explode("_bins").alias("b")).groupBy("lang", F.col("b.w").alias("word")).agg(F.sum("b.n").alias("n"))
    words = most_frequent(counts).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("words"))
    shares = F.transform("words", lambda x: x["n"] / F.col("tokens"))
    one = sums.join(words, "lang", "left").select(
        "lang", F.transform("chars", lambda x: x / F.col("total")).alias("chars"),
        F.coalesce(F.transform("words", lambda x: x["word"]), F.expr("cast(array() as array<string>)")).alias("words"),
        F.coalesce(shares, F.expr("cast(array() as array<double>)")).alias("shares"),
        F.coalesce(F.aggregate(shares, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)).alias("known"),
    )
    return one.agg(F.array_sort(F.collect_list(F.struct("lang", "chars", "words", "shares", "known"))).alias("refs"))


def term(p: Column, q: Column) -> Column:
    """What a bin with shares ``p`` and ``q`` adds to the Jensen-Shannon divergence, in bits."""
    half = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return (half(p) + half(q)) / 2


def class_divergence(ref: Column) -> Column:
    """Jensen-Shannon divergence of ``_chars`` from a reference's classes."""
    terms = F.zip_with("_chars", ref["chars"], lambda n, q: term(n / F.greatest(F.lit(1.0), "_total"), q))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def word_divergence(ref: Column) -> Column:
    """Jensen-Shannon divergence over a reference's frequent words, and the bin of all other words."""
    zero, one = F.lit(0.0), F.lit(1.0)
    own = F.transform("_bins", lambda b: F.struct((b["n"] / F.col("_tokens")).alias("p"), F.get(ref["shares"], F.array_position(ref["words"], b["w"]).cast("int") - 1).alias("q")))
    own = F.filter(own, lambda x: x["q"].isNotNull())
    add = lambda s, x: F.struct((s["d"] + term(x["p"], x["q"])).alias("d"), (s["p"] + x["p"]).alias("p"), (s["q"] + x["q"]).alias("q"))
    # Frequent words that do not occur, then the bin of all other words.
    whole = lambda s: s["d"] + F.greatest(zero, ref["known"] - s["q"]) / 2 + term(F.greatest(zero, one - s["p"]), F.greatest(zero, one - ref["known"]))
    return F.aggregate(own, F.struct(zero.alias("d"), zero.alias("p"), zero.alias("q")), add, whole)


def judged(profiled: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``like_language`` and the distances ``char_distance`` and ``word_distance`` of the nearest
    reference for rows that pass the base rules: of the own language's, or if the text is not like
    that (or has no such language) of all.  Of references equally near, the one with the smaller distances counts."""
    zero, one = F.lit(0.0), F.lit(1.0)
    out = profiled.withColumns({"_refs": refs.scalar(), "_total": F.aggregate("_chars", zero, lambda s, x: s + x)})
    long_enough, enough_words = F.col("_total") >= LEAST_CHARS, F.col("_tokens") >= LEAST_WORDS
    # Few words scatter: a limit is wider for a short text.
    most_chars, most_words = MOST_CHARS + SPREAD_CHARS / F.sqrt(F.greatest(one, "_total")), MOST_WORDS + SPREAD_WORDS / F.sqrt(F.greatest(one, "_tokens"))
    root = lambda x: F.sqrt(F.greatest(zero, x))

    def nearest(of: Column) -> Column:
        apart = F.transform(of, lambda r: F.struct(F.when(long_enough, root(class_divergence(r))).alias("char"), F.when(enough_words, root(word_divergence(r))).alias("word")))
        return F.array_min(F.transform(apart, lambda x: F.struct(F.greatest(F.coalesce(x["char"] / most_chars, zero), F.coalesce(x["word"] / most_words, zero)).alias("worst"), x["char"].alias("char"), x["word"].alias("word"))))

    passes = ~F.col("base_failed")
    out = out.withColumn("_own", F.when(passes, nearest(F.filter("_refs", lambda r: r["lang"] == F.col("lang")))))
    alike = F.coalesce(F.col("_own.worst") <= 1, F.lit(False))
    out = out.withColumn("_best", F.when(alike, F.col("_own")).when(passes, nearest(F.col("_refs"))))
    like = F.when(F.size("_refs") == 0, True).otherwise(F.coalesce(F.col("_best.worst") <= 1, F.lit(False)))
    return out.withColumns({"like_language": like, "char_distance": F.col("_best.char"), "word_distance": F.col("_best.word")}).drop("_refs", "_total", "_own", "_best")


def quality(docs: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Judges every whole text of ``docs`` (``doc_id, text, lang``).

    Keeps the columns ``carry`` (all by default) and adds the base counts, ``base_failed``, the two
    distances and ``kept``.  References are counted twice: over all documents that pass the base
    rules, then over those of them that are like a first reference.  A null or empty text has no
    words and fails; repeated rows are judged alike; without any labelled language only the base
    rules count; an empty table gives an empty table.  Columns of the same names are replaced."""
    words = vocabulary(docs)
    df = docs if carry is None else docs.select(*map(named, dict.fromkeys([*carry, "text", "lang"])))
    carried = unlike(list(carry or docs.columns), ADDED)
    df = set_aside(df, "text", "lang")
    own = [c for c in df.columns if c != "text" or "text" in carried]
    table = written(profiles(base_rules(df), words).select(*own, *ADDED[:6], "_chars", "_tokens", "_bins"), "profiles")
    passing = table.where("not base_failed")
    first = written(references(passing), "references")
    refs = written(references(judged(passing, first).where("like_language")), "references")
    out = judged(table, refs)
    return restored(out.withColumn("kept", ~F.col("base_failed") & F.col("like_language")), carried, *ADDED)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return quality(docs, carry=("doc_id",)).drop("like_language")
