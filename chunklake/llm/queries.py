"""The corpus operators as named queries over the driver's tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.llm.ann import nearest
from chunklake.llm.chat import CONTROL, END, START, digest, format_paths
from chunklake.llm.classifier import grades, score, train
from chunklake.llm.decontaminate import contamination, hit_words
from chunklake.llm.lines import repeated_units
from chunklake.llm.mixing import mix
from chunklake.llm.repeats import remove_repeats
from chunklake.llm.shards import shard_by_bytes
from chunklake.llm.simhash import simhash_components
from chunklake.llm.urls import judge_urls
from chunklake.operators.prefix import prefix_sums
from chunklake.session import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its own name, with its SQL if it has any."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


@query()
def op1_shards(spark, sf):
    dealt = shard_by_bytes(table(spark, sf, "documents"), shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _escaped(text: str) -> str:
    """SQL for the length-preserving part of the chat template's escape."""
    sql = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        sql = f"replace({sql}, '{c}', '{c[0]}\\{c[1:]}')"
    return sql


@query(f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id""")
def op2_chat(spark, sf):
    ok = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    ordered = [F.col("turn"), F.col("role"), F.col("text")]
    nodes = prefix_sums(turns.withColumn("_one", F.lit(1).cast("long")), ["conv_id"], ordered, {"node": "_one"})
    nodes = nodes.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")
    return digest(format_paths(materialize(nodes, "turns"), branches=1))


@query()
def op3_ann(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)  # also returns how many vectors were verified


@query()
def op4_mixing(spark, sf):
    mixed = mix(table(spark, sf, "documents"), weights=[3, 1, 2], share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op5_repeats(spark, sf):
    # passages of over 50 words can be shorter than 400 bytes: repeats from 260 bytes on stay in the text but are counted
    cut = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), length=400, report=260)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("n_marked").alias("n_repeated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
     wins AS (SELECT DISTINCT item_id, list_slice(w, s, least(s + 9, len(w))) AS win
              FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
     spots AS (SELECT doc_id, s, s + n AS e, list_slice(w, s, s + n - 1) AS win
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
     found AS (SELECT doc_id, s, e, item_id FROM spots JOIN wins USING (win)),
     hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, e)) AS p FROM found) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
               FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op6_decontamination(spark, sf):
    found = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        hit_words("runs").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


@query()
def op7_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = train(docs, grades(table(spark, sf, "labels")))
    return score(docs, model, at_least=2).where("p_select >= 0.5").select("doc_id", "expected_grade", "p_select")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query(f"""
WITH r AS (SELECT * FROM (VALUES {", ".join(map(str, RULES))}) AS t(rhost, rpath, rverdict)),
     u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     f AS (SELECT p.*, rhost || rpath AS rule, rverdict,
                  row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
           FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM f WHERE k = 1""")
def op8_urls(spark, sf):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules, default="allow")


@query()
def op9_simhash(spark, sf):
    return simhash_components(table(spark, sf, "documents"), radius=3, words_in_shingle=3, seed=42)


@query()
def op10_lines(spark, sf):
    return repeated_units(table(spark, sf, "documents"), min_words=10)
