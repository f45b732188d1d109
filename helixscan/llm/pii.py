"""Personal data by weak supervision, with DataFrame functions only.

Base spans come from patterns and checks.  Further candidates (keys and tokens, local phone numbers)
are judged by labelers that vote yes, no or nothing: the shape of the string, gazetteers that hold the words
before it, what stands around it, its variety, and its length.  Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is; a logistic classifier of a span's
votes, and of features that no labeler saw, is trained on the result and decides; a span for which it finds even odds is taken.  Patterns have
a fixed number of values, so that what comes to the driver does not grow with the corpus.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, named, restored, set_aside, unlike, written

#: In each pattern, a match can only begin where its first run of characters begins or where the last
#: match ended: elsewhere the match would have begun earlier.  Possessive loops need no way back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone")
KEY = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/=-]{16,}+"
LOCAL = r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: Words that name what follows them, in English, German, French and Spanish, and words of what looks alike (fixed values).
GAZETTEER = {
    "secret": "access api apikey auth authorization bearer client cookie credential credentials key login passphrase passwd password private pwd secret session sha signature token webhook "
    "geheim geheimnis kennwort passwort schlüssel zugang zugangsdaten clé jeton mot passe secrète clave contraseña ficha llave secreto",
    "number": "call cell cellphone contact fax hotline mobile phone sms tel telephone text whatsapp anruf anrufen durchwahl handy mobil rufnummer telefon telefonnummer "
    "appeler appelez fixe mobile numéro portable téléphone celular contacto llama llamar móvil número teléfono",
}
NOT_GAZETTEER = {
    "secret": "commit doi http https isbn md path revision url uuid www",
    "number": "artikel article bestellung commande doi invoice isbn issn item order page pedido ref reference rechnung sku version",
}
LABELERS = ("shape", "gazetteer", "context", "variety", "size")
#: Characters before a span that labelers see, and words of them that the gazetteers are asked for.
AROUND, NEAR = 32, 4
SPAN = "array<struct<start:int,end:int,text:string>>"
ROUNDS = 40


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    n = F.length(digits(m))
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", digits(m))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def found(df: DataFrame, name: str, pattern: str, trigger: Column, keep) -> DataFrame:
    """Adds ``name``: the matches of ``pattern`` in ``_text`` that ``keep`` lets pass, with their places
    in code points.  ``trigger``: whether the text can have any."""
    none = F.lit(None).cast("array<string>")
    df = df.withColumn("_match", F.when(trigger, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_gap", F.when(F.size("_match") > 0, F.split("_text", pattern, -1)).otherwise(none))
    df = df.withColumn("_both", F.zip_with(F.slice("_gap", F.lit(1), F.size("_match")), "_match", lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"))))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["g"]
        end = start + F.length(x["m"])
        new = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text")))
        return F.struct(end.alias("at"), F.when(keep(x["m"]), F.concat(s["out"], new)).otherwise(s["out"]).alias("out"))

    walked = F.aggregate("_both", F.expr(f"named_struct('at', 0, 'out', cast(array() as {SPAN}))"), step, lambda s: s["out"])
    return df.withColumn(name, F.coalesce(walked, F.expr(f"cast(array() as {SPAN})"))).drop("_match", "_gap", "_both")


def base_spans(df: DataFrame) -> DataFrame:
    """Adds an array of spans for each of ``KINDS``; needs ``_text``."""
    triggers = {"email": F.col("_text").contains("@"), "ip": F.col("_text").rlike(r"[0-9]\.[0-9]"), "card": F.col("_text").rlike("[0-9][ -]?[0-9]"), "phone": F.col("_text").contains("+")}
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True):
        df = found(df, f"_{kind}", pattern, triggers[kind], _keeping(kind))
    return df


def _keeping(kind: str):
    return lambda m: valid(kind, m)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def candidate(kind: str, span: Column) -> Column:
    """A candidate with its votes and features."""
    m, before = span["text"], F.substring(F.col("_text"), F.greatest(F.lit(1), span["start"] - AROUND + 1), F.least(F.lit(AROUND), span["start"]))
    after = F.substring(F.col("_text"), span["end"] + 1, F.lit(1))
    n, kinds = F.length(m), F.size(F.array_distinct(F.split(m, "")))
    n_digits = F.length(digits(m))
    if kind == "secret":
        shape = vote(m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_+/=-]{20,})$"), m.rlike("^[0-9-]+$") | (n_digits * 10 < n))
        variety, size = vote(kinds >= 12, kinds < 8), vote(n.isin(32, 36, 40, 64) | (n > 28), n < 18)
        context = vote(before.rlike(r"[=:]\s*[\"']?$"), before.rlike(r"[/.]$") | after.isin("/", "."))
    else:
        shape = vote(m.rlike(r"^\([0-9]{3}\)|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), m.rlike(r"\."))
        variety, size = vote(kinds >= 6, kinds < 4), vote(n_digits == 10, n_digits != 10)
        context = vote(before.rlike(r"[:(]\s*$"), before.rlike(r"[0-9][ .-]?$") | after.rlike(r"[%€$]"))
    words = F.slice(F.reverse(F.filter(F.split(F.lower(before), r"[^\p{L}]+"), lambda w: w != "")), F.lit(1), F.lit(NEAR))
    listed = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names[kind].split())))
    gazetteer = vote(listed(GAZETTEER), listed(NOT_GAZETTEER))
    votes = F.concat_ws(",", *[v.cast("string") for v in (shape, gazetteer, context, variety, size)])
    beside = F.when(before.rlike(r"\p{L}$"), "letter").when(before.rlike("[0-9]$"), "digit").when(before.rlike(r"\s$") | (span["start"] == 0), "blank").otherwise("mark")
    begins = F.when(m.rlike("^[0-9]"), "digit").when(m.rlike("^[a-z]"), "small").when(m.rlike("^[A-Z]"), "capital").otherwise("mark")
    features = F.concat_ws(",", beside, begins, F.least(F.lit(4), F.floor(n / 12)).cast("string"), F.floor(F.lit(4) * n_digits / n).cast("string"), after.isin('"', "'").cast("string"))
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), votes.alias("votes"), features.alias("features"))


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds the base spans and ``_candidates``, none of which overlaps a base span."""
    df = base_spans(docs.withColumn("_text", F.coalesce("text", F.lit(""))))
    df = found(df, "_key", KEY, F.col("_text").rlike("[0-9]"), lambda m: F.lit(True))
    df = found(df, "_local", LOCAL, F.col("_text").rlike(r"[0-9]{3}[ .-][0-9]{4}"), lambda m: F.lit(True))
    df = df.withColumn("_base", F.concat(*[F.col(f"_{k}") for k in KINDS]))
    free = lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    df = df.withColumn("_key", F.filter("_key", free)).withColumn("_local", F.filter("_local", free))
    df = df.withColumn("_candidates", F.concat(F.transform("_key", lambda s: candidate("secret", s)), F.transform("_local", lambda s: candidate("number", s))))
    return df.drop("_key", "_local", "_base", "_text")


def reliabilities(patterns: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Expectation-maximisation over counts of (kind, votes): the probability that a span with these votes is personal data."""
    votes = {p: [int(v) for v in p[1].split(",")] for p in patterns}
    belief = {p: 1 / (1 + math.exp(-1.5 * sum(v))) for p, v in votes.items()}
    for _ in range(ROUNDS):
        count: dict = defaultdict(lambda: 1.0)
        for p, n in patterns.items():
            for y, w in ((1, belief[p] * n), (0, (1 - belief[p]) * n)):
                count[p[0], y] += w
                for j, v in enumerate(votes[p]):
                    count[p[0], y, j, v] += w
        for p, v in votes.items():
            k = p[0]
            odds = math.log(count[k, 1] / count[k, 0])
            for j, x in enumerate(v):
                share = [count[k, y, j, x] / sum(count[k, y, j, z] for z in (-1, 0, 1)) for y in (0, 1)]
                odds += math.log(share[1] / share[0])
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def names_of(kind: str, votes: str, features: str) -> list[str]:
    """The binary features of a span."""
    parts = [f"vote{j}={v}" for j, v in enumerate(votes.split(","))] + [f"feature{j}={v}" for j, v in enumerate(features.split(","))]
    return [kind, *[f"{kind}:{x}" for x in parts]]


def train(patterns: list[tuple[str, str, str, int]], rounds: int = 300, rate: float = 0.5) -> dict[str, float]:
    """Weights of a logistic classifier of (kind, votes, features) patterns, by gradient descent on their counts."""
    by_votes: dict[tuple[str, str], float] = defaultdict(float)
    for kind, votes, _, n in patterns:
        by_votes[kind, votes] += n
    belief = reliabilities(dict(by_votes))
    total = sum(p[3] for p in patterns)
    rows = [(names_of(k, v, f), belief[k, v], n / total) for k, v, f, n in patterns]
    weights: dict[str, float] = defaultdict(float)
    for _ in range(rounds):
        step: dict[str, float] = defaultdict(float)
        for names, y, share in rows:
            p = 1 / (1 + math.exp(-sum(weights[x] for x in names)))
            for x in names:
                step[x] += share * (y - p)
        for x, d in step.items():
            weights[x] += rate * (d - 1e-4 * weights[x])
    return dict(weights)


def decided(kind: Column, votes: Column, features: Column, accepted: list[tuple[str, str, str]]) -> Column:
    """Whether the classifier takes the span.  There are finitely many patterns: the accepted ones are a literal."""
    return F.concat_ws(";", kind, votes, features).isin([";".join(p) for p in accepted])


def personal_data(docs: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Finds personal data in every whole text of ``docs``.

    Keeps the columns ``carry`` (all by default) and adds ``n_email, n_ip, n_card, n_phone``,
    ``base_sha256``, ``spans`` (kind:start:end, the base ones first, then ``secret`` and ``number``) and
    ``found`` (the spans as structs).  A null or empty text has none; repeated rows are treated alike; an empty table
    gives an empty table; columns named like the new ones are replaced."""
    new = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found")
    carried = unlike(list(carry or docs.columns), new)
    df = set_aside(docs if carry is None else docs.select(*map(named, dict.fromkeys([*carry, "text"]))), "text")
    spans = [F.transform(f"_{k}", _place).alias(f"_{k}") for k in KINDS]
    own = [c for c in df.columns if c != "text" or "text" in carried]
    table = written(with_candidates(df).select(*own, *spans, "_candidates"), "candidates")
    counts = table.select(F.explode("_candidates").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n")).collect()
    patterns = sorted((r["kind"], r["votes"], r["features"], r["n"]) for r in counts)
    weights = train(patterns) if patterns else {}
    accepted = [p[:3] for p in patterns if sum(weights[x] for x in names_of(*p[:3])) >= 0]
    more = F.filter("_candidates", lambda c: decided(c["kind"], c["votes"], c["features"], accepted))
    more = F.array_sort(F.transform(more, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    out = table.withColumn("_more", more)
    base = F.concat(*[F.transform(f"_{k}", _named(k)) for k in KINDS])
    out = out.withColumn("_base", base)
    written_out = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    out = out.withColumn("found", F.concat("_base", "_more"))
    out = out.select(
        *own,
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written_out("_base"), 256).alias("base_sha256"), written_out("found").alias("spans"), "found",
    )
    return restored(out, carried, *new)


def _place(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"))


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def masked(text: str | Column, spans: str | Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap count as one, of the first kind."""
    text = F.col(text) if isinstance(text, str) else text
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(s: Column, x: Column) -> Column:
        new = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], new).otherwise(s["out"]).alias("out"))

    walked = F.aggregate(in_order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) > 0, F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text)))).otherwise(text)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir).select("doc_id", "text"), carry=("doc_id",)).drop("found")
