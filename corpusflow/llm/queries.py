"""Registered queries of the operators, on whole tables with production settings, and SQL twins where SQL can say it."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import alignment, bytebpe, codes, langid, linededup, neardup, packing, pii, quality, simhash, spelling, toolcalls, toxicity
from corpusflow.llm.storage import ready
from corpusflow.session import shared_folder

QUERIES, SQL = {}, {}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ready(spark)
        return f(spark, sf)

    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op2_addressable_codes(spark, sf):
    folder = shared_folder(spark, "codes")
    codes.write_codes(table(spark, sf, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return codes.documents_of(codes.read_codes(spark, folder))


@query
def op3_compression_bands(spark, sf):
    return quality.measure(table(spark, sf, "documents"))


@query
def op5_byte_bpe(spark, sf):
    return bytebpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op8_first_fit_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_byte_position_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op6_pca_tiles(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "embeddings"))


SQL["op6_pca_tiles"] = """WITH RECURSIVE
fine AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id"""


@query
def op9_kneser_ney_toxicity(spark, sf):
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op10_byte_network_language(spark, sf):
    return langid.identify(table(spark, sf, "documents"))


@query
def op4_bootstrapped_pii(spark, sf):
    return pii.find(table(spark, sf, "documents"))


#: Tools that the calls below name, with the schemas of their arguments; a call by turn names the tool turn % 5.
TOOLS = [
    ("search", '{"type":"object","required":["query"],"properties":{"query":{"type":"string"},"limit":{"type":"integer","minimum":1,"maximum":5},"after":{"type":"string"}},"additionalProperties":false}'),
    ("summarise", '{"type":"object","required":["query","limit"],"properties":{"limit":{"type":"integer"}}}'),
    ("translate", '{"type":"object","required":["query","to"],"properties":{"to":{"enum":["de","en"]}}}'),
    ("rank", '{"type":"object","properties":{"limit":{"type":["integer","null"],"maximum":7}},"additionalProperties":true}'),
]


@query
def op1_tool_calls(spark, sf):
    """Assistant turns as calls with their whole text as an argument, the turns behind them as results.

    Calls refer to the call two turns earlier, every sixth to the one two turns later.
    """
    turns = table(spark, sf, "conversations")
    call_id = F.concat(F.lit("call_"), "conv_id", F.lit("_"))
    names = F.array(*[F.lit(n) for n in ("search", "summarise", "translate", "rank", "unlisted")])
    other = F.when(F.col("turn") % 6 == 1, F.col("turn") + 2).when(F.col("turn") % 6 != 3, F.col("turn") - 2)
    reference = F.concat(F.lit('{ "$ref" : "'), call_id, other, F.lit('"}'))
    arguments = F.concat(F.lit('{"query": '), toolcalls.as_json("text"), F.lit(', "limit": '), F.col("turn") % 8,
                         F.coalesce(F.concat(F.lit(', "after": '), reference), F.lit("")), F.lit("}"))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", F.concat(call_id, "turn").alias("call_id"), F.col("turn").alias("seq"),
        F.get(names, (F.col("turn") % 5).cast("int")).alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'user'").select(
        "conv_id", F.concat(call_id, F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return toolcalls.link(calls, results, spark.createDataFrame(TOOLS, "name string, schema string"))


SQL["op1_tool_calls"] = """WITH c AS (SELECT conv_id, 'call_' || conv_id || '_' || turn AS call_id, turn AS seq, text, turn % 8 AS l,
    CASE WHEN turn % 6 = 1 THEN turn + 2 WHEN turn % 6 <> 3 THEN turn - 2 END AS ref,
    ['search', 'summarise', 'translate', 'rank', 'unlisted'][turn % 5 + 1] AS name FROM conversations WHERE role = 'assistant'),
r AS (SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'user'),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.name, c.seq, c.text, c.l, c.ref, r.content,
    c.call_id IS NOT NULL AS has_call, r.call_id IS NOT NULL AS has_result, p.seq AS target
    FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id LEFT JOIN c p ON p.conv_id = c.conv_id AND p.seq = c.ref),
e AS (SELECT *, CASE WHEN NOT has_call THEN ['no call'] ELSE
    CASE name WHEN 'search' THEN CASE WHEN l < 1 THEN ['$.limit: below minimum'] WHEN l > 5 THEN ['$.limit: above maximum'] ELSE [] END
        WHEN 'translate' THEN ['$.to: missing'] WHEN 'unlisted' THEN ['$: unknown tool'] ELSE [] END
    || CASE WHEN ref IS NOT NULL AND target IS NULL THEN ['$ref call_' || conv_id || '_' || ref || ': missing'] ELSE [] END END AS errs FROM j)
SELECT conv_id, call_id, name, seq, CASE WHEN NOT has_call THEN 'no_call' WHEN NOT has_result THEN 'no_result' ELSE 'linked' END AS status,
    has_call::BIGINT AS n_calls, has_result::BIGINT AS n_results, CASE WHEN target > seq THEN target ELSE seq END AS ready,
    CASE WHEN NOT has_call THEN NULL WHEN target > seq THEN 1 ELSE 0 END::BIGINT AS depth, CASE WHEN has_call THEN false END AS cyclic,
    len(errs) = 0 AS valid, array_to_string(errs, '; ') AS errors,
    CASE WHEN has_call THEN '{"arguments":{' || CASE WHEN ref IS NOT NULL THEN '"after":{"$ref":"call_' || conv_id || '_' || ref || '"},' ELSE '' END
        || '"limit":' || l || ',"query":' || to_json(text) || '}' ELSE '{"arguments":null' END || ',"id":"' || call_id || '","name":'
        || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS canonical FROM e"""


@query
def op12_line_bitmaps(spark, sf):
    return linededup.deduplicate(table(spark, sf, "documents"))


_BLANK = r"[\x20\x09-\x0D]+"
SQL["op12_line_bitmaps"] = f"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM t),
k AS (SELECT *, translate(regexp_replace(line, '^{_BLANK}|{_BLANK}$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, coalesce(k.doc_id <> c.last, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""


@query
def op13_reduced_alphabet(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))


@query
def op11_spilled_alignment(spark, sf):
    return alignment.align(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
