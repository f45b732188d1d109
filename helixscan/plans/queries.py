"""The engine's operators over sequences made from the driver's tables: one query for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from helixscan.functions import chars, cigar, sql
from helixscan.operators import align as aligner
from helixscan.operators import ball as balls
from helixscan.operators import cluster as clusters
from helixscan.operators import filters, legacy, nearest, profile, redundancy, reference
from helixscan.sources import fasta, files, sinks
from helixscan.sources.storage import shared_path
from helixscan.streaming import cluster as stream_clusters
from helixscan.streaming import search

from .fixtures import queries as query_records
from .fixtures import references as reference_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Parameters of the registered queries.
BEST, RADIUS, TRIM, CLUSTER_DISTANCE = 10, 2, 7, 1


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def renamed(df: DataFrame, each: int = 40) -> DataFrame:
    """Names that references and queries share."""
    return df.withColumn("name", F.concat(F.lit("seq"), (F.col("ordinal") % each).cast("string")))


def clear_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_records(spark, sf_dir).where(filters.query_is_clear(F.col("seq")))


def pairs(spark: SparkSession, sf_dir: str, trim: int = 0) -> DataFrame:
    """Every reference with a query: the one of the same number, modulo the number of queries."""
    return chars.with_pair_counts(partners(spark, sf_dir), "q", "r", trim)


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query_records(spark, sf_dir)
    n = F.lit(q.count())
    q = q.select(F.pmod("ordinal", n).alias("_n"), F.col("ordinal").alias("query_ordinal"), F.col("seq").alias("q"))
    return reference_records(spark, sf_dir).select(F.pmod("ordinal", n).alias("_n"), "ordinal", F.col("seq").alias("r")).join(q, "_n").drop("_n")


def unaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(reference_records(spark, sf_dir))


def edited(records: DataFrame) -> DataFrame:
    """Without gaps and Ns, with bases deleted and inserted, some records cut."""
    e, letters = F.col("ordinal"), F.split("seq", "")
    bases = F.transform(letters, lambda c, i: F.when(c.isin("N", "-") | ((e * 13 + i) % 97 == 0), "").when((e * 11 + i) % 101 == 0, F.concat(c, F.lit("T"))).otherwise(c))
    whole = F.array_join(bases, "")
    return records.withColumn("seq", F.when(e % 9 == 4, F.substring(whole, F.lit(31), F.length(whole))).when(e % 11 == 5, F.concat(whole, F.reverse(whole))).otherwise(whole))


def backbone(spark: SparkSession, sf_dir: str) -> str:
    return reference.backbone(reference_records(spark, sf_dir))


# Text and counts


@query
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.lower(F.substring("seq", 1, 60)), F.lit(" "), F.substring("seq", 61, 60), F.lit("\t"))
    return reference_records(spark, sf_dir).select("ordinal", chars.normalise(messy).alias("seq"))


@query
def trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_records(spark, sf_dir).select("ordinal", chars.trimmed(F.col("seq"), TRIM).alias("seq"))


@query
def char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = chars.sites(reference_records(spark, sf_dir), "seq", "ordinal")
    kind = F.when(chars.is_acgt(F.col("c")), "acgt").when(chars.is_valid(F.col("c")), "partial").otherwise("invalid")
    return at.groupBy("ordinal").agg(*[F.count_if(kind == k).alias(f"n_{k}") for k in ("acgt", "partial", "invalid")])


@query
def compress_acgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_records(spark, sf_dir).select("ordinal", chars.compress_acgt(F.col("seq")).alias("seq"))


@query
def count_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_records(spark, sf_dir).select("ordinal", chars.count_valid(F.col("seq")).alias("n"))


@query
def count_acgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_records(spark, sf_dir).select("ordinal", chars.count_acgt(F.col("seq")).alias("n"))


@query
def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    acgt, invalid = chars.proportions(F.col("seq"))
    return reference_records(spark, sf_dir).select("ordinal", acgt.alias("acgt"), invalid.alias("invalid"))


# Filters


@query
def filter_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clear_queries(spark, sf_dir).select("ordinal", "name")


@query
def filter_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_records(spark, sf_dir).where(filters.reference_is_clear(F.col("seq"), 0.3)).select("ordinal", "name")


@query
def filter_refs_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_records(spark, sf_dir).where(filters.ball_reference_is_clear_as_written(F.col("seq"), 0.3)).select("ordinal", "name")


@query
def filter_unaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unaligned(spark, sf_dir).where(filters.unaligned_is_clear(F.col("seq"), 120)).select("ordinal", "name")


@query
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.run_counters(renamed(reference_records(spark, sf_dir), 400), renamed(clear_queries(spark, sf_dir)))


@query
def observed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from the search itself, in its own pass over the references."""
    counters = Observation()
    found = nearest.nearest(renamed(reference_records(spark, sf_dir), 400), renamed(query_records(spark, sf_dir)), counters, n=BEST, exclude_self=True)
    found.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([counters.get])


# Site profile


@query
def site_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.site_profile(clear_queries(spark, sf_dir))


@query
def site_profile_acgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.site_profile(clear_queries(spark, sf_dir), acgt=True, trim=TRIM)


@query
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.consensus(profile.site_profile(clear_queries(spark, sf_dir)))


@query
def site_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.class_counts(profile.site_profile(clear_queries(spark, sf_dir)))


@query
def query_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.query_order(clear_queries(spark, sf_dir))


# Pairs


@query
def pair_score_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("query_ordinal", "ordinal", "acgt", "text", "partial", "valid")


@query
def pair_score_acgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("query_ordinal", "ordinal", (F.col("acgt_valid") - F.col("acgt")).alias("mismatches"), "acgt_valid")


@query
def pair_acgt_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, TRIM).select("query_ordinal", "ordinal", (F.col("acgt_valid") - F.col("acgt")).alias("distance"))


@query
def pair_text_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, TRIM).select("query_ordinal", "ordinal", (F.col("valid") - F.col("text")).alias("distance"))


@query
def pair_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, TRIM).select("query_ordinal", "ordinal", F.col("hamming").alias("distance"))


@query
def resolution_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return p.select("query_ordinal", "ordinal", chars.resolution(F.col("left_only"), F.col("right_only")).alias("known"), chars.resolution(F.col("left_acgt_only"), F.col("right_acgt_only")).alias("acgt"))


# Nearest references


def table(df: DataFrame) -> DataFrame:
    return df.drop("query_ordinal", "ref_ordinal")


def found(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return nearest.nearest(reference_records(spark, sf_dir), query_records(spark, sf_dir), n=BEST, **options)


@query
def nn_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(found(spark, sf_dir))


@query
def nn_acgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(found(spark, sf_dir, acgt=True))


@query
def nn_exclude_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nearest.nearest(renamed(reference_records(spark, sf_dir), 400), renamed(query_records(spark, sf_dir)), n=BEST, exclude_self=True)
    return out.select("query_ordinal", "ref_ordinal", "rank", *nearest.FULL)


@query
def nn_keep_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(found(spark, sf_dir, keep_resolved=True))


@query
def nn_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(found(spark, sf_dir, trim=TRIM))


@query
def nn_reference_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.closest_names(found(spark, sf_dir), BEST)


@query
def snp_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.snp_distance(found(spark, sf_dir)).select("query", "reference", "snp_distance")


@query
def snp_distance_acgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.snp_distance(found(spark, sf_dir, acgt=True), acgt=True).select("query", "reference", "snp_distance")


@query
def nn_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of the best references of every query."""
    return table(nearest.worst_of(found(spark, sf_dir)))


@query
def closest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.closest_names(found(spark, sf_dir))


@query
def closest_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.closest_alignment(found(spark, sf_dir), reference_records(spark, sf_dir))


@query
def keep_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.keep_resolved(clear_queries(spark, sf_dir)).select("ordinal", "name")


@query
def keep_less_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.keep_less_resolved(clear_queries(spark, sf_dir)).select("ordinal", "name")


# Ball


def in_ball(spark: SparkSession, sf_dir: str, mode: str, acgt: bool = False) -> DataFrame:
    return balls.ball(reference_records(spark, sf_dir), query_records(spark, sf_dir), mode, distance=RADIUS, acgt=acgt).select("ordinal", "name", "distance")


@query
def ball_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_ball(spark, sf_dir, balls.PAIR)


@query
def ball_acgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_ball(spark, sf_dir, balls.PAIR, acgt=True)


@query
def ball_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_ball(spark, sf_dir, balls.CONSENSUS)


@query
def ball_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_ball(spark, sf_dir, balls.AS_WRITTEN)


# The older search


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.legacy_scores(reference_records(spark, sf_dir), query_records(spark, sf_dir))


@query
def legacy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(scores(spark, sf_dir))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.legacy_search(reference_records(spark, sf_dir), query_records(spark, sf_dir))


@query
def legacy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(listed(spark, sf_dir))


@query
def legacy_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.legacy_chosen(listed(spark, sf_dir), reference_records(spark, sf_dir)).select("ordinal", "name")


# Reference genome, alignment, clusters


@query
def synth_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.synthesised(reference_records(spark, sf_dir))


@query
def snp_vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.snp_vs_reference(reference_records(spark, sf_dir), backbone(spark, sf_dir), n=2).drop("name")


@query
def snp_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.snp_counter(reference_records(spark, sf_dir), backbone(spark, sf_dir))


@query
def snp_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.snp_sites(snp_counter(spark, sf_dir))


@query
def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligner.align(nearest.spread(unaligned(spark, sf_dir)), backbone(spark, sf_dir))


@query
def align_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost of every alignment."""
    return align(spark, sf_dir).select("ordinal", "cost")


@query
def align_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the operations of every alignment say what its letters are, and the cost and lengths that follow from them."""
    base, rows = backbone(spark, sf_dir), nearest.spread(unaligned(spark, sf_dir))
    found = aligner.align(rows, base).select("ordinal", F.col("seq").alias("projection"), "cigar")
    c, seq = F.col("cigar"), F.col("seq")
    whole = found.join(rows.select("ordinal", "seq"), "ordinal")
    # Letters of pairs, gaps left out on both sides: in the reference where the projection has none, and the sequence with its insertions.
    pairs = F.aggregate(F.zip_with(F.split("projection", ""), F.split(F.lit(base), ""), lambda a, b: F.when(a == "-", 0).when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return whole.select(
        "ordinal", cigar.cost(c).alias("cost"), cigar.ref_sites(c).alias("ref_sites"), cigar.seq_letters(c).alias("seq_letters"), F.length("projection").cast("long").alias("projected"),
        (cigar.is_cigar(c) & (pairs == cigar.count(c, "M")) & (F.length(F.translate("projection", "-", "")) == cigar.count(c, "MX")) & (F.length(seq) == cigar.count(c, "MXI"))).alias("agrees"),
    )


@query
def cluster_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.leader(reference_records(spark, sf_dir), backbone(spark, sf_dir), CLUSTER_DISTANCE)
    return out.select("queue", "medoid", "member")


@query
def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(reference_records(spark, sf_dir), backbone(spark, sf_dir), CLUSTER_DISTANCE).select("medoid", "member")


@query
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.sizes(clusters.cluster(reference_records(spark, sf_dir), backbone(spark, sf_dir), CLUSTER_DISTANCE))


@query
def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.table(clusters.cluster(reference_records(spark, sf_dir), backbone(spark, sf_dir), CLUSTER_DISTANCE))


@query
def cluster_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of the medoids, written in the final order and read again."""
    records, path = reference_records(spark, sf_dir), shared_path(spark, "medoids")
    sinks.write_alignment(clusters.medoid_alignment(clusters.cluster(records, backbone(spark, sf_dir), CLUSTER_DISTANCE), records), path)
    return fasta.read_fasta_text(spark, path)


@query
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair scores through the functions registered for SQL text."""
    sql.register(spark)
    return partners(spark, sf_dir).selectExpr("query_ordinal", "ordinal", "seq_acgt_matches(q, r) AS acgt", "seq_text_matches(q, r) AS text", "seq_partial_matches(q, r) AS partial", "seq_valid_pairs(q, r) AS valid")


@query
def sql_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return partners(spark, sf_dir).selectExpr("query_ordinal", "ordinal", "seq_resolution(q, r) AS known", "seq_resolution_acgt(q, r) AS acgt")


@query
def sql_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return partners(spark, sf_dir).selectExpr("query_ordinal", "ordinal", "round(seq_weighted_matches(q, r), 3) AS partial_matches")


@query
def sql_snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the first record of the references and the first SNP site, in SQL text."""
    sql.register(spark)
    _, first = fasta.first_record(reference_records(spark, sf_dir))
    sites = reference_records(spark, sf_dir).selectExpr("ordinal", f"seq_snp_sites(seq, '{first}') AS sites")
    return sites.selectExpr("ordinal", "CAST(size(sites) AS BIGINT) AS distance", "coalesce(get(sites, 0), -1L) AS snp_1")


# Files and streams


@query
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "fasta")
    fasta.fasta_text(reference_records(spark, sf_dir)).write.option("compression", "gzip").text(path)
    return fasta.read_fasta_text(spark, path).select("name", "seq")


@query
def fasta_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files, plain and bzip2, read together; records are numbered over all of them."""
    path = shared_path(spark, "fasta")
    sinks.write_alignment(reference_records(spark, sf_dir), f"{path}/a", "none")
    sinks.write_alignment(query_records(spark, sf_dir), f"{path}/b", "bzip2")
    return fasta.read_fasta_text(spark, [f"{path}/a", f"{path}/b"])


@query
def nn_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's table written as CSV in the order of resolution, and read again with the order of its queries."""
    path = shared_path(spark, "table")
    order = profile.query_order(clear_queries(spark, sf_dir))
    sinks.write_table(found(spark, sf_dir), order, path)
    return sinks.read_table(spark, path).join(order.select(F.col("name").alias("query"), "resolution_order"), "query")


@query
def fasta_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as xz by the FASTA sink and read by the FASTA source."""
    path = shared_path(spark, "fasta")
    fasta.write_fasta(nearest.spread(reference_records(spark, sf_dir)), path, "xz")
    return fasta.read_fasta(spark, [p for p, _ in files.listed(path)]).select("name", "seq")


@query
def fasta_xz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """xz files of several blocks, each read in several tasks; records are numbered over all of them."""
    path = shared_path(spark, "fasta")
    fasta.write_fasta(reference_records(spark, sf_dir).orderBy("ordinal"), path, "xz", block_size=5_000)
    return fasta.read_fasta(spark, [p for p, _ in files.listed(path)], part_size=12_000)


def reference_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' files as they arrive, as sequences."""
    from .fixtures import sequences

    schema = spark.read.parquet(f"{sf_dir}/customer.parquet").schema
    return sequences(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/customer.parquet*"), "c_custkey", 0, "ref")


@query
def stream_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(search.stream_nearest(reference_stream(spark, sf_dir), query_records(spark, sf_dir), n=BEST)).drop("entered_at_batch")


@query
def stream_fasta_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over FASTA files as they arrive."""
    path = shared_path(spark, "fasta")
    sinks.write_alignment(nearest.spread(reference_records(spark, sf_dir)), path)
    return table(search.stream_nearest(fasta.stream_fasta(spark, path), query_records(spark, sf_dir), n=BEST)).drop("entered_at_batch")


@query
def stream_entrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references that were among the best of a query after some batch; a batch is a quarter of the references."""
    path, refs = shared_path(spark, "quarters"), reference_records(spark, sf_dir)
    for k in range(4):
        refs.where(F.col("ordinal") % 4 == k).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(refs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    folder = shared_path(spark, "entrants")
    search.stream_nearest(stream, query_records(spark, sf_dir), entrants=folder, n=BEST)
    return spark.read.parquet(folder).select("query", "reference", F.col("entered_at_batch").cast("long").alias("entered_at_batch"))


@query
def stream_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.stream_ball(reference_stream(spark, sf_dir), query_records(spark, sf_dir), distance=RADIUS).select("ordinal", "name", "distance")


@query
def stream_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least costs of records that arrive as a stream."""
    return search.stream_align(edited(reference_stream(spark, sf_dir)), backbone(spark, sf_dir)).select("ordinal", "cost")


@query
def stream_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clustering with the state of each queue kept from batch to batch."""
    return stream_clusters.stream_cluster(reference_stream(spark, sf_dir), backbone(spark, sf_dir), CLUSTER_DISTANCE).select("queue", "medoid", "member")
