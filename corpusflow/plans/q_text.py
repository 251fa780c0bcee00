"""Registered text-model queries (TF, LG, BN, CQ) and their SQL twins."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators import corpuscheck as cq
from corpusflow.operators import textmodel as tm
from corpusflow.plans.tables import table

CUES = {"contains": ["tion", "heit", "menta"], "exact": ["est", "sich", "por"], "prefix": ["reen", "unge"], "names": ["ándose"]}


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def _weighted(spark, sf):
    return _docs(spark, sf).select(F.col("lang").alias("label"), "text", tm.example_weight(F.col("text")).alias("weight"))


def _quality(spark, sf):
    labels = table(spark, sf, "labels")
    return table(spark, sf, "documents").join(labels, "doc_id").select(
        "doc_id", "text", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))


@cache
def language_model(spark, sf):
    """Trained once in a session for all queries that only use it."""
    return tm.train_nb(_weighted(spark, sf))


@cache
def quality_model(spark, sf):
    return tm.train_binary_nb(_quality(spark, sf), "good", "bad")


def tf1_char_ngrams(spark, sf):
    return tm.char_ngrams(_docs(spark, sf), ["lang"], "text")


def tf2_letter_count(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.letter_count(F.col("text")).cast("long").alias("letters"))


def tf3_script_profile(spark, sf):
    mixed = _docs(spark, sf).withColumn("text", F.concat(
        F.col("text"), F.when(F.col("doc_id") % 5 == 1, F.translate("text", "aeiou", "αβγδε"))
        .when(F.col("doc_id") % 5 == 2, F.translate("text", "aeioust", "авгджзи")).otherwise(F.lit(""))))
    return tm.script_profile(mixed).select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("letters", "latin", "cyrillic", "greek", "other")],
        "restrict_script", "unsupported")


def tf5_example_weight(spark, sf):
    return _docs(spark, sf).select("doc_id", tm.example_weight(tx.strip(F.col("text"))).alias("weight"))


def tf6_greetings(spark, sf):
    """Titles of parts looked up among phrases derived from part names."""
    parts = table(spark, sf, "part")
    phrases = parts.groupBy(tm.greeting_key(F.col("p_name")).alias("phrase")).agg(
        F.array(F.min("p_type"), F.max("p_type")).alias("codes"))
    texts = parts.select("p_partkey", F.concat(F.lit(" "), F.upper("p_name"), F.lit("!! 1")).alias("text"))
    out = tm.match_greetings(texts, phrases)
    scores = tm.greeting_scores(F.array_distinct("greeting_codes"))
    return out.filter("greeting_codes IS NOT NULL").select(
        "p_partkey", scores[0]["code"].alias("code"), F.round(scores[0]["p"], 6).alias("p"))


def tf7_cue_match(spark, sf):
    return _docs(spark, sf).select("doc_id", tm.cue_match(F.col("text"), CUES).alias("hit"))


def lg1_train_nb(spark, sf):
    model = tm.train_nb(_weighted(spark, sf))
    return model.likelihood_table().select("label", "ngram", F.round("log_likelihood", 4).alias("log_likelihood"))


def lg1_priors(spark, sf):
    return tm.train_nb(_weighted(spark, sf)).prior_table().select(
        "label", F.round("log_prior", 6).alias("log_prior"), F.round("unseen", 6).alias("unseen"), F.round("tokens", 2).alias("tokens"))


def _turn_texts(spark, sf):
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")


def lg2_score_nb(spark, sf):
    model = language_model(spark, sf)
    return tm.label_probabilities(_turn_texts(spark, sf), model).select(
        "doc_id", "label", F.round("score", 3).alias("score"), F.round("p", 4).alias("p"),
        F.col("seen").cast("long").alias("seen"), F.col("word_seen").cast("long").alias("word_seen"),
        F.col("tokens").cast("long").alias("tokens"), F.col("word_tokens").cast("long").alias("word_tokens"))


def lg4_language_decision(spark, sf):
    model = language_model(spark, sf)
    return tm.decide_language(_turn_texts(spark, sf), model).select(
        "doc_id", "code", F.round("p", 4).alias("p"), F.round("coverage", 4).alias("coverage"),
        "is_unknown", "is_ambiguous", "reason")


def lg5_detect(spark, sf):
    model = language_model(spark, sf)
    decided = tm.decide_language(_turn_texts(spark, sf), model)
    return tm.detect_language(decided, ["de", "en", "fr"]).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def lg6_confusion(spark, sf):
    model = language_model(spark, sf)
    docs = _docs(spark, sf)
    best = tm.rank_labels(tm.score_nb(docs, model), model.labels).select("doc_id", F.col("ranked")[0]["code"].alias("pred"))
    return tm.evaluate(docs.join(best, "doc_id").withColumn("truth", F.col("lang")))[0]


def bn1_binary_nb(spark, sf):
    model = quality_model(spark, sf)
    return tm.score_binary_nb(_docs(spark, sf), model, "good", "bad").select("doc_id", "label", F.round("p", 4).alias("p"))


def bn2_positive(spark, sf):
    model = quality_model(spark, sf)
    return tm.is_positive(tm.score_binary_nb(_docs(spark, sf), model, "good", "bad"), "good", 0.45).select("doc_id", "label")


def bn3_gate(spark, sf):
    model = quality_model(spark, sf)
    return tm.abuse_gate(_docs(spark, sf), model, ["worthless"], ["the ", "und"], reject="bad", ok="good")


def bn4_scope_gate(spark, sf):
    model = quality_model(spark, sf)
    return tm.scope_gate(_docs(spark, sf), model, {"contains": ["heit", "blebl"]}, positive="good", negative="bad")


def _label_lines(spark, sf):
    """Labels from the language: runs of equal labels form the blocks."""
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("line"), F.when(F.col("lang") == "en", "in").when(
        F.col("lang") != "es", "out").otherwise("skip").alias("label"))


def cq1_blocks(spark, sf):
    return cq.block_completeness(cq.label_blocks(_label_lines(spark, sf), "in", "out"), "in", "out", 2)


def cq2_template_swaps(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), F.col("lang").alias("block"), "text")
    return cq.template_swaps(texts).select("block", "text_id", "need")


def cq3_repeated(spark, sf):
    return cq.repeated_texts(table(spark, sf, "documents"), "lang")


QUERIES = {f.__name__: f for f in (
    tf1_char_ngrams, tf2_letter_count, tf3_script_profile, tf5_example_weight, tf6_greetings, tf7_cue_match,
    lg1_train_nb, lg1_priors, lg2_score_nb, lg4_language_decision, lg5_detect, lg6_confusion, bn1_binary_nb,
    bn2_positive, bn3_gate, bn4_scope_gate, cq1_blocks, cq2_template_swaps, cq3_repeated)}


def _grams(source: str, name: str) -> str:
    """CTE: n-grams per distinct word of a CTE with a column word."""
    return f"""{name}w AS (SELECT DISTINCT word FROM {source}),
        {name} AS (SELECT word, substr(' ' || word || ' ', i::BIGINT, n::BIGINT) AS ngram FROM {name}w, range(1, 5) a(n), LATERAL (SELECT unnest(range(1, length(word) + 4 - n)) AS i)
            UNION ALL SELECT word, 'w:' || word FROM {name}w WHERE length(word) <= 14)"""


def _words(source: str, keys: str, name: str = "words", weight: str = "1") -> str:
    return f"""{name}_raw AS (SELECT {keys}, {weight} AS weight, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{M}}]+')) AS word FROM {source}),
        {name} AS (SELECT {keys}, word, sum(weight) AS n FROM {name}_raw WHERE word <> '' GROUP BY ALL)"""


_LETTERS = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"


def _weight(text: str = "text", letters: str = _LETTERS) -> str:
    end = f"right({text}, 1) IN ('.', '?', '!', '։', '…')"
    return f"CASE WHEN {letters} < 12 THEN 0.2 WHEN {end} AND {letters} >= 25 THEN 1.0 WHEN {end} THEN 0.7 ELSE 0.35 END::DOUBLE"


def _train(source: str, smoothing: float) -> str:
    """CTEs lik(label, ngram, lp), lab(label, prior, unseen, tokens) from source(label, text, w)."""
    return f"""{_words(source, 'label', 'tw', 'w')}, {_grams('tw', 'tg')},
        cnt AS (SELECT label, ngram, sum(n)::DOUBLE AS c FROM tw JOIN tg USING (word) GROUP BY ALL),
        voc AS (SELECT count(DISTINCT ngram) AS v FROM cnt), dw AS (SELECT label, sum(w)::DOUBLE AS d FROM {source} GROUP BY ALL),
        tot AS (SELECT label, sum(c) AS tokens FROM cnt GROUP BY ALL),
        lab AS (SELECT label, tokens, tokens + {smoothing} * v AS den, ln((d + {smoothing}) / ((SELECT sum(d) FROM dw) + {smoothing} * (SELECT count(*) FROM dw))) AS prior,
            ln({smoothing} / (tokens + {smoothing} * v)) AS unseen FROM tot JOIN dw USING (label), voc),
        lik AS (SELECT label, ngram, ln((c + {smoothing}) / den)::FLOAT AS lp FROM cnt JOIN lab USING (label))"""


def _score(source: str) -> str:
    """CTE sc(doc_id, label, score, seen, word_seen, tokens, word_tokens, p) for source(doc_id, text)."""
    return f"""{_words(source, 'doc_id', 'sw')}, {_grams('sw', 'sg')},
        wl AS (SELECT word, label, sum(lp::DOUBLE - unseen) AS g, count(*) AS s, count(*) FILTER (ngram LIKE 'w:%') AS w
            FROM sg JOIN lik USING (ngram) JOIN lab USING (label) GROUP BY ALL),
        wt AS (SELECT word, count(*) AS t, count(*) FILTER (ngram LIKE 'w:%') AS w FROM sg GROUP BY ALL),
        dt AS (SELECT doc_id, sum(n * t)::BIGINT AS tokens, sum(n * w)::BIGINT AS word_tokens FROM sw JOIN wt USING (word) GROUP BY ALL),
        dl AS (SELECT doc_id, label, sum(n * g)::DOUBLE AS g, sum(n * s)::BIGINT AS s, sum(n * w)::BIGINT AS w FROM sw JOIN wl USING (word) GROUP BY ALL),
        raw AS (SELECT dt.doc_id, l.label, prior + unseen * dt.tokens + coalesce(g, 0) AS score, coalesce(s, 0) AS seen, coalesce(w, 0) AS word_seen,
            dt.tokens, word_tokens FROM dt CROSS JOIN lab l LEFT JOIN dl ON dl.doc_id = dt.doc_id AND dl.label = l.label),
        ex AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM raw),
        sc AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM ex)"""


_LANG_SRC = f"src AS (SELECT lang AS label, text, {_weight()} AS w FROM documents)"
_TURN_SRC = "turn AS (SELECT conv_id * 100 + turn AS doc_id, text FROM conversations)"
_BIN_SRC = "src AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label, text, 1 AS w FROM documents JOIN labels USING (doc_id))"
_BIN = f"""{_BIN_SRC}, {_train('src', 0.5)}, {_score('documents')},
    two AS (SELECT doc_id, max(p) FILTER (label = 'good') AS p FROM sc GROUP BY ALL),
    bin AS (SELECT d.doc_id, text, CASE WHEN {_LETTERS} >= 2 AND p >= 0.5 THEN 'good' ELSE 'bad' END AS label,
        CASE WHEN {_LETTERS} < 2 OR p IS NULL THEN 1.0 WHEN p >= 0.5 THEN p ELSE 1 - p END AS p FROM documents d LEFT JOIN two USING (doc_id))"""
_DECIDE = f"""{_LANG_SRC}, {_train('src', 0.45)}, {_TURN_SRC}, {_score('turn')},
    rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label) AS r FROM sc),
    agg AS (SELECT doc_id, max(label) FILTER (r = 1) AS top, max(p) FILTER (r = 1) AS p1, max(p) FILTER (r = 2) AS p2,
        max(seen) FILTER (r = 1)::DOUBLE / max(tokens) AS cov, CASE WHEN max(word_tokens) > 0 THEN max(word_seen) FILTER (r = 1)::DOUBLE / max(word_tokens) ELSE 0 END AS wcov,
        max(word_tokens) AS wt, count(*) FILTER (word_tokens > 0 AND word_seen::DOUBLE / word_tokens >= 0.4) AS shared,
        arg_max(label, [word_seen, -r]) FILTER (word_tokens > 0 AND word_seen::DOUBLE / word_tokens >= 0.4) AS flat_top,
        max(word_seen) FILTER (word_tokens > 0 AND word_seen::DOUBLE / word_tokens >= 0.4) AS flat_max,
        sum(word_seen) FILTER (word_tokens > 0 AND word_seen::DOUBLE / word_tokens >= 0.4) AS flat_sum FROM rk GROUP BY doc_id),
    dec AS (SELECT t.doc_id, agg.* EXCLUDE (doc_id), CASE WHEN {_LETTERS} < 2 THEN 'too_short' WHEN top IS NULL THEN 'no_letters' WHEN cov < 0.28 THEN 'low_coverage'
        WHEN wt > 0 AND wcov < 0.12 AND p1 < 0.92 THEN 'low_word_coverage' WHEN wt > 0 AND {_LETTERS} <= 96 AND shared >= 2 THEN 'shared_words'
        WHEN p1 - p2 < 0.04 THEN 'small_margin' WHEN p1 < 0.36 THEN 'low_confidence' ELSE 'detected' END AS reason FROM turn t LEFT JOIN agg USING (doc_id)),
    fin AS (SELECT doc_id, reason, reason IN ('too_short', 'no_letters', 'low_coverage', 'low_word_coverage', 'low_confidence') AS is_unknown,
        reason IN ('shared_words', 'small_margin') AS is_ambiguous,
        CASE WHEN reason = 'shared_words' THEN flat_top WHEN reason IN ('detected', 'small_margin') THEN top END AS code,
        CASE WHEN reason IN ('too_short', 'no_letters') THEN 0 WHEN reason = 'shared_words' THEN flat_max::DOUBLE / flat_sum ELSE p1 END AS p,
        CASE WHEN reason IN ('shared_words', 'detected', 'small_margin') THEN cov ELSE 0 END AS coverage FROM dec)"""

_FOLD = "strip_accents(replace(lower(text), 'ß', 'ss'))"

SQL = {
    "tf1_char_ngrams": f"""WITH {_words('documents', 'lang')}, {_grams('words', 'g')}
        SELECT lang, ngram, sum(n)::BIGINT AS n FROM words JOIN g USING (word) GROUP BY ALL""",
    "tf2_letter_count": f"SELECT doc_id, {_LETTERS} AS letters FROM documents",
    "tf3_script_profile": """WITH m AS (SELECT doc_id, regexp_replace(text || CASE doc_id % 5 WHEN 1 THEN translate(text, 'aeiou', 'αβγδε')
            WHEN 2 THEN translate(text, 'aeioust', 'авгджзи') ELSE '' END, '[^\\p{L}]', '', 'g') AS l FROM documents),
        c AS (SELECT doc_id, length(l) AS letters, length(regexp_replace(l, '[^\\x{0}-\\x{24F}\\x{1E00}-\\x{1EFF}]', '', 'g')) AS latin,
            length(regexp_replace(l, '[^\\x{400}-\\x{52F}]', '', 'g')) AS cyrillic, length(regexp_replace(l, '[^\\x{370}-\\x{3FF}]', '', 'g')) AS greek FROM m),
        o AS (SELECT *, letters - latin - cyrillic - greek AS other FROM c)
        SELECT *, CASE WHEN letters >= 4 AND greatest(latin, cyrillic, greek, other) >= letters * 0.7 THEN
            CASE greatest(latin, cyrillic, greek, other) WHEN greek THEN 'greek' WHEN cyrillic THEN 'cyrillic' END END AS restrict_script,
            letters >= 4 AND other >= 4 AND other >= letters * 0.4 AS unsupported FROM o""",
    "tf5_example_weight": "WITH d AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents) SELECT doc_id, "
                          + _weight() + " AS weight FROM d",
    "tf6_greetings": """WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^\\p{L} ]', '', 'g')) AS phrase, p_type FROM part),
        g AS (SELECT phrase, min(p_type) AS a, max(p_type) AS b FROM p GROUP BY ALL)
        SELECT p_partkey, a AS code, CASE WHEN a = b THEN 0.97 ELSE 0.78 END::DOUBLE AS p FROM p JOIN g USING (phrase)""",
    "tf7_cue_match": f"""SELECT doc_id, regexp_matches({_FOLD}, 'tion|heit|menta|ándose|(^|[^\\p{{L}}])(est|sich|por)($|[^\\p{{L}}])|(^|[^\\p{{L}}])(reen|unge)') AS hit FROM documents""",
    "lg1_train_nb": f"WITH {_LANG_SRC}, {_train('src', 0.45)} SELECT label, ngram, round(lp::DOUBLE, 4) AS log_likelihood FROM lik",
    "lg1_priors": f"""WITH {_LANG_SRC}, {_train('src', 0.45)} SELECT label, round(prior, 6) AS log_prior, round(unseen, 6) AS unseen,
        round(tokens, 2) AS tokens FROM lab""",
    "lg2_score_nb": f"""WITH {_LANG_SRC}, {_train('src', 0.45)}, {_TURN_SRC}, {_score('turn')}
        SELECT doc_id, label, round(score, 3) AS score, round(p, 4) AS p, seen, word_seen, tokens, word_tokens FROM sc""",
    "lg4_language_decision": f"""WITH {_DECIDE} SELECT doc_id, code, round(p, 4) AS p, round(coverage, 4) AS coverage, is_unknown, is_ambiguous, reason FROM fin""",
    "lg5_detect": f"""WITH {_DECIDE} SELECT CASE WHEN NOT is_unknown AND NOT is_ambiguous AND code IN ('de', 'en', 'fr') THEN code ELSE 'de' END AS language,
        count(*) AS n FROM fin GROUP BY ALL""",
    "lg6_confusion": f"""WITH {_LANG_SRC}, {_train('src', 0.45)}, {_score('documents')},
        best AS (SELECT doc_id, label AS pred FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label) = 1)
        SELECT lang AS truth, pred, count(*) AS n FROM documents JOIN best USING (doc_id) GROUP BY ALL""",
    "bn1_binary_nb": f"WITH {_BIN} SELECT doc_id, label, round(p, 4) AS p FROM bin",
    "bn2_positive": f"WITH {_BIN} SELECT doc_id, label FROM bin WHERE label = 'good' AND p >= 0.45",
    "bn3_gate": f"""WITH {_BIN}, g AS (SELECT *, CASE WHEN regexp_replace(text, '\\s', '', 'g') = '' THEN 'blank' WHEN contains(lower(text), 'worthless') THEN 'hard_marker'
        WHEN NOT contains(lower(text), 'the ') AND NOT contains(lower(text), 'und') THEN 'no_marker' ELSE 'model' END AS gate FROM bin)
        SELECT doc_id, CASE gate WHEN 'hard_marker' THEN false WHEN 'model' THEN NOT (label = 'bad' AND p >= 0.55) ELSE true END AS passes, gate FROM g""",
    "bn4_scope_gate": f"""WITH {_BIN} SELECT doc_id, regexp_matches({_FOLD}, 'heit|blebl') OR (label = 'good' AND p >= 0.42) AS in_scope,
        CASE WHEN regexp_matches({_FOLD}, 'heit|blebl') THEN 'cue' ELSE 'model' END AS gate FROM bin""",
    "cq1_blocks": """WITH l AS (SELECT doc_id AS line, CASE WHEN lang = 'en' THEN 'in' ELSE 'out' END AS label FROM documents WHERE lang <> 'es'),
        s AS (SELECT *, CASE WHEN label = 'in' AND lag(label) OVER (ORDER BY line) = 'out' THEN 1 ELSE 0 END AS st FROM l),
        b AS (SELECT label, sum(st) OVER (ORDER BY line)::BIGINT AS block FROM s)
        SELECT block, count(*) FILTER (label = 'in') AS positives, count(*) FILTER (label = 'out') AS negatives,
        count(*) FILTER (label = 'in') >= 2 AND count(*) FILTER (label = 'out') >= 2 AS complete FROM b GROUP BY ALL""",
    "cq2_template_swaps": """WITH d AS (SELECT doc_id, lang, text, greatest(40, ceil(round(length(text) * 0.55::DOUBLE, 9))::BIGINT) AS need, substr(text, 1, 40) AS p
            FROM documents WHERE length(text) >= 40)
        SELECT lang AS block, doc_id AS text_id, need FROM d s WHERE EXISTS (SELECT 1 FROM d x WHERE x.lang = s.lang AND x.p = s.p
            AND x.doc_id <> s.doc_id AND length(x.text) >= s.need AND substr(x.text, 1, s.need) = substr(s.text, 1, s.need))""",
    "cq3_repeated": "SELECT lang, sha256(trim(text)) AS text_hash, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1",
}
