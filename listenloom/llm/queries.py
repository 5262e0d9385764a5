"""The subpackage's queries over whole tables, and SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listenloom.llm.clusters import describe_clusters, probed_pairs, similarity_clusters
from listenloom.llm.cooccur import cooccurring_pairs
from listenloom.llm.heavy import frequent_values
from listenloom.llm.match import match_recordings
from listenloom.llm.mixing import mix_sources
from listenloom.llm.packing import fill_report, pack_documents
from listenloom.llm.residue import mark_residue
from listenloom.llm.runs import repeated_runs


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id_a, session_id_b``: probed sessions of one set that belong to one group."""
    members = similarity_clusters(spark.read.parquet(f"{sf_dir}/session_table.parquet").select("session_id", "vectors"))
    return probed_pairs(members, spark.read.parquet(f"{sf_dir}/probe_sessions.parquet"))


def p1_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's size, share, most typical sessions and top items."""
    sessions = spark.read.parquet(f"{sf_dir}/session_table.parquet").select("session_id", "vectors", "items")
    return describe_clusters(similarity_clusters(sessions), sessions, spark.read.parquet(f"{sf_dir}/track_catalog.parquet"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field_name, field_value``: values of artist or track that make up at least 1/200 of its rows."""
    return frequent_values(spark.read.parquet(f"{sf_dir}/plays.parquet"), ["artist", "track"], 1 / 200).select("field_name", "field_value")


P2_SQL = """
WITH long AS (
  SELECT 'artist' AS field_name, artist AS field_value FROM plays WHERE regexp_matches(artist, '[^\\s\\x{00a0}]')
  UNION ALL SELECT 'track', track FROM plays WHERE regexp_matches(track, '[^\\s\\x{00a0}]')
), total AS (SELECT field_name, count(*) AS n FROM long GROUP BY field_name)
SELECT field_name, field_value FROM long JOIN total USING (field_name) GROUP BY field_name, field_value, n HAVING count(*) * 200 >= n
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, first_play_id, last_play_id, n_plays`` of each run of one recording."""
    return repeated_runs(spark.read.parquet(f"{sf_dir}/plays.parquet")).select("user_id", "first_play_id", "last_play_id", "n_plays")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_index, ext_id``: listing and catalog item are one recording."""
    return match_recordings(spark.read.parquet(f"{sf_dir}/ext_tracks.parquet"), spark.read.parquet(f"{sf_dir}/track_catalog.parquet")).select("item_index", "ext_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_a, item_b``: pairs in at least 6 sessions, at least ten times as often as by chance."""
    return cooccurring_pairs(spark.read.parquet(f"{sf_dir}/session_table.parquet"), min_count=6, min_lift=10).select("item_a", "item_b")


P6_SQL = """
WITH e AS (SELECT DISTINCT session_id, item FROM (SELECT session_id, unnest(items) AS item FROM session_table) WHERE session_id IS NOT NULL AND item >= 2),
n AS (SELECT count(DISTINCT session_id) AS n FROM e),
k AS (SELECT item, count(*) AS c FROM e GROUP BY item),
p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS c FROM e a JOIN e b ON a.session_id = b.session_id AND a.item < b.item GROUP BY 1, 2)
SELECT item_a, item_b FROM p JOIN k ka ON ka.item = item_a JOIN k kb ON kb.item = item_b, n WHERE p.c >= 6 AND p.c * n.n >= 10 * ka.c * kb.c
"""


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container, document, piece, first token and length of every piece."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers it took, and how full they are."""
    return fill_report(p8_packed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str, **how) -> tuple[DataFrame, DataFrame]:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet"), **how)


def p9_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in the mixture."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share each source reached."""
    return _mixed(spark, sf_dir)[1]


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document where as many tokens are wanted as there are, so that repetition limits bind and shares are tempered."""
    return _mixed(spark, sf_dir, epochs=1.0)[0]


def p9_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached and the exponent where as many tokens are wanted as there are."""
    return _mixed(spark, sf_dir, epochs=1.0)[1]


def p9_flat_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of all sources at nine tenths of the entropy of equal ones, each document used four times at most."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), None, flatness=0.9, repeats=4)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` of every document that is residue of a template or of a page that didn't load."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mark_residue(documents).where("residue is not null").select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_archetypes": p1_archetypes, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_draws": p9_draws, "p9_shares": p9_shares, "p9_tempered": p9_tempered, "p9_tempered_shares": p9_tempered_shares, "p9_flat_shares": p9_flat_shares, "p10_found": p10_found}
ORACLES = {"p2_found": P2_SQL, "p6_found": P6_SQL}
