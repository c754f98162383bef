"""The registered queries of the corpus operators, each beside its SQL where SQL can express it."""

from __future__ import annotations

import os
import re
import textwrap
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import bpe, decontaminate, divergence, edit_counts, html_text, kneser_ney, language_id, line_frequency, periodic_runs, quality, secrets, va_search
from cohortry.llm.common import table
from cohortry.llm.jaccard_join import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """The content of a public tokenizer's file; ``PUBLIC_TOKENIZERS`` names another folder."""
    folder = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
    with open(os.path.join(folder, name), encoding="utf-8") as file:
        return file.read()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL where there is one."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = textwrap.dedent(sql).strip()
        return fn

    return register


@query("op1_ngram_jaccard_join", """
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    links AS (
        SELECT l.doc_id AS a, r.doc_id AS b
        FROM shingles l JOIN shingles r ON l.s = r.s AND l.doc_id <> r.doc_id
        JOIN sizes p ON p.doc_id = l.doc_id JOIN sizes q ON q.doc_id = r.doc_id
        GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))),
    reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN sizes USING (doc_id)
    LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
""")
def op1(spark: SparkSession, directory: str) -> DataFrame:
    """Near-duplicate components of the documents: five-word shingles, Jaccard similarity of 0.8 or more."""
    return near_duplicates(table(spark, directory, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op2_co_training_quality")
def op2(spark: SparkSession, directory: str) -> DataFrame:
    """The quality of every document by a text view and a metadata view that taught each other."""
    docs = table(spark, directory, "documents").select("doc_id", "text", "source", "lang")
    return quality.scored(docs, quality.fit(docs, table(spark, directory, "labels")))


@query("op3_page_differencing")
def op3(spark: SparkSession, directory: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, directory, "pages"))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, directory: str) -> DataFrame:
    """Every document and benchmark item that it leaks, by latent semantic retrieval and exact checks."""
    return decontaminate.find_leaks(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@query("op5_edit_aware_counts")
def op5(spark: SparkSession, directory: str) -> DataFrame:
    """Token counts of every document before and after an edit: runs of signs and long numbers become one mark."""
    ranks = tokenizer_file("byte_bpe_50k.tiktoken").encode()
    docs = table(spark, directory, "documents").select("doc_id", "text")
    rows = edit_counts.build(edit_counts.pattern_edits(docs, r"[#$%&*!]{2,}|[0-9]{6,}", "*"), ranks)
    before = rows.withColumn("n_tokens", edit_counts.n_tokens())
    after = edit_counts.update(before, ranks)
    return after.select("doc_id", "n_tokens", F.size("edits").cast("long").alias("n_edits"),
                        edit_counts.n_tokens().alias("n_tokens_after"), F.length("text").cast("long").alias("n_chars_after"), "recoded")


@query("op6_va_file_top_k", """
    WITH vectors AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def op6(spark: SparkSession, directory: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector, by integer inner product."""
    return va_search.top_k(table(spark, directory, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op7_kneser_ney_scores")
def op7(spark: SparkSession, directory: str) -> DataFrame:
    """The log10 probability of every document under a Kneser-Ney model of six sevenths of the documents."""
    held = language_id.held_out(7, 2)
    docs = table(spark, directory, "documents").select("doc_id", "text").withColumn("held_out", held)
    model = kneser_ney.fit(docs.where(~held))
    return kneser_ney.scores(docs, model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op8_language_id")
def op8(spark: SparkSession, directory: str) -> DataFrame:
    """The language of every document by bitmask n-gram filters, learned from four fifths of the documents."""
    docs = table(spark, directory, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out(5, 0)
    model = language_id.fit(docs.where(~held))
    return docs.withColumn("held_out", held).withColumn("guess", language_id.predicted(docs, model)).select(
        "doc_id", "held_out", F.col("guess.language").alias("lang_pred"), F.col("guess.score").alias("score"))


@query("op9_bpe_tree_concatenation")
def op9(spark: SparkSession, directory: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    docs = table(spark, directory, "documents")
    return bpe.encode(docs, tokenizer_file("word_bpe_49k.json"), ["doc_id"]).select(
        "doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op10_secret_novelty")
def op10(spark: SparkSession, directory: str) -> DataFrame:
    """The secrets of every document: spans of the fixed patterns and of novel strings."""
    docs = table(spark, directory, "documents").select("doc_id", "text")
    spans = secrets.secret_spans(docs, secrets.identifier_dictionary(docs))
    base = F.filter("all_spans", lambda s: s["kind"] != "novel")
    counts = [F.expr(f"cast(size(filter(all_spans, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return docs.withColumn("all_spans", spans).select(
        "doc_id", *counts, F.sha2(secrets.span_list(base), 256).alias("base_sha256"),
        secrets.span_list(F.col("all_spans")).alias("spans"))


@query("op11_line_frequency", """
    WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    words AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
    windows AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (
            SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8))),
    repeats AS (
        SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(8) AS r(k) WHERE n > 1 GROUP BY doc_id),
    parts AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS raw FROM texts),
    lines AS (
        SELECT *, translate(array_to_string(found, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS line
        FROM (SELECT *, regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+') AS found FROM parts) WHERE len(found) > 0),
    twice AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lines GROUP BY doc_id),
    hosts AS (SELECT source, count(DISTINCT t) AS documents FROM texts GROUP BY source),
    common AS (
        SELECT l.source, line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
        GROUP BY l.source, line, documents HAVING count(DISTINCT t) >= 10 AND 1000 * count(DISTINCT t) >= 10 * documents),
    gone AS (
        SELECT doc_id, sum(len(found)) AS n FROM lines l JOIN common c ON l.line = c.line AND l.source IS NOT DISTINCT FROM c.source
        GROUP BY doc_id),
    joined AS (
        SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
            len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(twice.n, 0) AS n_dup_lines,
            coalesce(repeats.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_common_words
        FROM words LEFT JOIN twice USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN gone USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_common_words >= 20 AND 100 * n_common_words <= 50 * n_words AS kept,
        n_common_words
    FROM joined
""")
def op11(spark: SparkSession, directory: str) -> DataFrame:
    """The quality counts of every document, and whether it is kept once the common lines of its source are gone."""
    found = line_frequency.audited(table(spark, directory, "documents"), ["doc_id"])
    return found.select("doc_id", *line_frequency.COUNTS, "base_failed", "kept", "n_common_words")


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """Texts whose id has a crc32 divisible by ten, with their words repeated from one of them on; others as they are."""
    code = F.crc32(doc_id.cast("string"))

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, codes in columns:
            out = []
            for t, h in zip(texts, codes):
                words = re.findall(r"[^\x20\x09-\x0D]+", t.as_py() or "")
                if words:
                    n, g = len(words), h.as_py() // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    words[a:] = (words[a:a + p] * ((n - a) // p + 1))[:n - a]
                out.append(" ".join(words) if t.is_valid else None)
            yield pa.array(out, pa.string())

    changed = F.arrow_udf(run, "string")(F.when(code % 10 == 0, text), code)
    return F.coalesce(changed, text)


@query("op12_periodic_runs")
def op12(spark: SparkSession, directory: str) -> DataFrame:
    """The periodic runs of every document, the strongest of them, and the text without their repetitions, as digests."""
    docs = table(spark, directory, "documents").select("doc_id", "text")
    found = periodic_runs.with_runs(docs, ["doc_id"], with_planted_period(F.col("text"), F.col("doc_id")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("best", periodic_runs.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_source_divergence", """
    WITH d AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents),
    terms AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM terms GROUP BY ALL HAVING count(DISTINCT id) >= 30),
    groups AS (SELECT DISTINCT lang, source FROM d),
    counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
    cells AS (
        SELECT lang, source, term, coalesce(n, 0) AS n
        FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
    whole AS (SELECT lang, term, sum(n)::BIGINT AS n FROM cells GROUP BY ALL),
    p AS (
        SELECT *, (1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER g + 5 * count(*) OVER g))::BIGINT AS p
        FROM cells WINDOW g AS (PARTITION BY lang, source)),
    q AS (
        SELECT *, (1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER g + 5 * count(*) OVER g))::BIGINT AS q
        FROM whole WINDOW g AS (PARTITION BY lang)),
    apart AS (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    found AS (
        SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
        FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
        LEFT JOIN apart a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source
        UNION ALL
        SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
    ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
""")
def op13(spark: SparkSession, directory: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that a source has more of than its language."""
    return divergence.audited(table(spark, directory, "documents"))
