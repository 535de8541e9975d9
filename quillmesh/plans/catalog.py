"""Registered queries over the test tables, and the SQL that each is held against.

Notes are made from ``documents`` and questions from ``benchmark`` in the same way on
either side; the SQL is written on its own, from the semantics, not from our expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.config import RetrievalConfig
from quillmesh.functions import text as tx
from quillmesh.functions.layout import checked_broadcast, spread
from quillmesh.functions.parts import containing
from quillmesh.operators import answers as an
from quillmesh.operators import chunking, evaluation, lexical, notes, ranking, vectors
from quillmesh.plans import hybrid

CFG = RetrievalConfig()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def one_chunk_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a note of one chunk."""
    note = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".md"))
    title = F.concat("source", F.lit(" "), F.col("doc_id").cast("string"))
    link = F.concat(F.lit("src/"), (F.col("doc_id") + 1).cast("string"))
    return table(spark, sf, "documents").select(
        F.concat(note, F.lit("#1")).alias("chunk_id"), note.alias("note_id"), title.alias("title"), title.alias("section"), "text",
        F.array("lang", "source").alias("tags"), F.array(link).alias("links"), F.lit(1).alias("position"),
    )


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """(id, path, lang, text): documents dressed as Markdown."""
    key = F.col("doc_id").cast("string")
    tag = F.concat(F.lit("#"), F.col("lang"), F.lit(" and #"), F.col("source"), F.lit("/part-a"))
    link = F.concat(F.lit("[[src/"), (F.col("doc_id") + 1).cast("string"), F.lit("| the next ]] [[src/"), (F.col("doc_id") + 1).cast("string"), F.lit("]] [[Top#Head]]"))
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Head "), key, F.lit("\n"))).when(F.col("doc_id") % 3 == 1, F.lit("lead in\n###  Deep head \n")).otherwise(F.lit(""))
    tail = F.when(F.col("doc_id") % 2 == 0, F.lit("\n## Tail\n- one **two** three\n2. four\n#not a head\n## \nlast. Words!")).otherwise(F.lit(""))
    text = F.concat(head, tag, F.lit("\n"), link, F.lit("\n"), F.col("text"), tail)
    return spread(table(spark, sf, "documents")).select(F.concat(F.lit("src/"), key, F.lit(".md")).alias("path"), "lang", text.alias("text"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("item_id") % 3 == 0, " #en").when(F.col("item_id") % 3 == 1, " #src1 #EN #src1").otherwise("")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.concat("text", tail).alias("text"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("item"), "text")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _index(spark: SparkSession, sf: str) -> hybrid.IndexTables:
    index = hybrid.build_index(one_chunk_notes(spark, sf), CFG, scan=True)
    # What one task reads is kept.  More is made anew for each pass: that costs less than to write it to disk and read it.
    return index.persist() if table(spark, sf, "documents").rdd.getNumPartitions() == 1 else index


def _hits(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    """BM25 hits of the benchmark over documents, as hits; kept, as they are few and used more than once."""
    top = checked_broadcast(lexical.bm25_topk(asked(spark, sf), items(spark, sf), k).persist())
    chunks = one_chunk_notes(spark, sf).withColumn("item", F.regexp_extract("note_id", r"(\d+)", 1).cast("long"))
    return top.join(chunks, "item").select("qid", "rank", "score", "chunk_id", "note_id", "title", "section", "text").persist()


def _relevant(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items with the documents that contain them; an item without one keeps an id that nothing matches."""
    b, d = table(spark, sf, "benchmark"), spread(table(spark, sf, "documents"))
    pairs = containing(d.select("doc_id", "text"), b.select("item_id", F.col("text").alias("part")), "item_id")
    found = pairs.groupBy("item_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".md#1")))).alias("ids"))
    rows = b.join(found, "item_id", "left").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.coalesce("ids", F.array(F.lit("none.md#1"))).alias("relevant_chunk_ids"))
    return evaluation.relevants(rows)


def tokens_lex(spark, sf):
    return spread(table(spark, sf, "documents")).select(F.explode(tx.lex_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def tokens_embed(spark, sf):
    return spread(table(spark, sf, "documents")).select(F.explode(tx.embed_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def hash_buckets(spark, sf):
    return vectors.buckets(spread(table(spark, sf, "documents")), "doc_id", "text")


def tf_vectors(spark, sf):
    return vectors.tf_vectors(spread(table(spark, sf, "documents")), "doc_id", "text").withColumn("w", F.round("w", 6))


def dense_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.dense_topk(e.where("vec_id < 20").select(F.col("vec_id").alias("qid"), "embedding"), e, 10)


def dense_topk_all(spark, sf):
    """Every row as a query."""
    e = table(spark, sf, "embeddings")
    return vectors.dense_topk(e.select(F.col("vec_id").alias("qid"), "embedding"), e, 10)


def sparse_topk(spark, sf):
    return vectors.sparse_topk(asked(spark, sf), items(spark, sf), 10).select("qid", "item", "score", "rank")


def bm25_stats(spark, sf):
    docs = items(spark, sf)
    return lexical.term_stats(lexical.postings(docs), lexical.corpus_stats(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf):
    return lexical.bm25_topk(asked(spark, sf), items(spark, sf), 10)


def rrf_fusion(spark, sf):
    ranked = hybrid.ranked_legs(_index(spark, sf), questions(spark, sf), CFG)
    return ranking.fuse(ranked, CFG.rrf_k).select("qid", "chunk_id", "rrf")


def tag_boost(spark, sf):
    q = questions(spark, sf).select("qid", tx.query_tags(F.col("text")).alias("qtags")).where(F.size("qtags") > 0)
    pairs = one_chunk_notes(spark, sf).crossJoin(checked_broadcast(q))
    boost = CFG.tag_boost * ranking.tag_overlap(F.col("qtags"), F.col("tags"))
    return pairs.select("qid", "chunk_id", F.round(boost, 6).alias("boost")).where("boost > 0")


def link_boost(spark, sf):
    index = _index(spark, sf)
    keys = ranking.link_keys(hybrid.ranked_legs(index, questions(spark, sf), CFG).persist(), CFG.link_hits)
    return ranking.related_notes(keys, ranking.aliases(index.passages, keys.select("alias").distinct()), CFG.link_notes)


def note_aliases(spark, sf):
    return ranking.aliases(one_chunk_notes(spark, sf))


def keyword_guard(spark, sf):
    terms = hybrid.query_stats(_index(spark, sf), questions(spark, sf))[0]
    return ranking.keywords(terms, CFG).select("qid", F.array_join("keywords", " ").alias("keywords"))


def note_cap_topk(spark, sf):
    top = vectors.sparse_topk(asked(spark, sf), items(spark, sf), 40)
    noted = top.join(table(spark, sf, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("note_id")), "item")
    scored = noted.select("qid", "note_id", "item", "score", F.col("score").alias("rrf"), F.col("rank").alias("seen"))
    return ranking.top_hits(scored, CFG).select("qid", "item", "note_id", "score", "rank")


def hybrid_topk(spark, sf):
    return hybrid.retrieve(_index(spark, sf), questions(spark, sf), CFG)


def note_title(spark, sf):
    return notes.notes_from_files(markdown(spark, sf)).select("id", "title")


def note_tags(spark, sf):
    return notes.notes_from_files(markdown(spark, sf)).select("id", F.array_join("tags", "|").alias("tags"))


def note_links(spark, sf):
    return notes.notes_from_files(markdown(spark, sf)).select("id", F.array_join("links", "|").alias("links"))


def tag_exclude(spark, sf):
    return notes.exclude_tags(notes.notes_from_files(markdown(spark, sf)), ["en", "src3/part-a"]).select("id")


def sections(spark, sf):
    named = markdown(spark, sf).select("path", F.posexplode(chunking.sections(F.col("text"), F.col("path"))).alias("nth", "s"))
    return named.select("path", "nth", F.col("s.section").alias("section"), F.col("s.text").alias("text"))


def clean_text(spark, sf):
    return markdown(spark, sf).select("path", chunking.clean_markdown(F.col("text")).alias("text"))


def sentences(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("nth", "sentence"))


def chunks(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(chunking.pack(F.col("text"))).alias("nth", "chunk"))


def chunk_notes(spark, sf):
    made = chunking.chunk_notes(notes.notes_from_files(markdown(spark, sf)))
    return made.select("chunk_id", "note_id", "title", "section", "text", "position")


def passages(spark, sf):
    return vectors.with_passage(one_chunk_notes(spark, sf)).select("chunk_id", "passage")


def context_budget(spark, sf):
    return an.context_blocks(_hits(spark, sf), CFG.context_chars).select("qid", "rank", F.length("block").alias("chars"), "upto")


def sources_text(spark, sf):
    return an.sources_block(_hits(spark, sf))


def compact_sources(spark, sf):
    return an.compact_sources(_hits(spark, sf), 2)


def extractive_answer(spark, sf):
    return an.extractive(asked(spark, sf), _hits(spark, sf))


def plan_route(spark, sf):
    q = asked(spark, sf).withColumn("text", F.when(F.col("qid") % 2 == 0, F.concat(F.lit("Please OPEN (src\\"), F.col("qid").cast("string"), F.lit(".md now, "), F.col("text"))).otherwise(F.col("text")))
    return an.route(q).select("qid", "tool", "note_id", "k")


def expand_query(spark, sf):
    q = asked(spark, sf).withColumn("text", F.when(F.col("qid") % 4 == 0, F.substring_index("text", " ", 2)).when(F.col("qid") % 4 == 1, F.lit("?! ...")).otherwise(F.col("text")))
    return q.select("qid", an.expand_query(F.col("text")).alias("expanded"))


def message_split(spark, sf):
    return an.split_message(table(spark, sf, "documents").select("doc_id", "text"), most=1_000).select("doc_id", "part", "piece")


def corpus_counts(spark, sf):
    return an.corpus_counts(one_chunk_notes(spark, sf))


def recall_mrr(spark, sf):
    return evaluation.retrieval_metrics(evaluation.first_ranks(_relevant(spark, sf), _hits(spark, sf, 10)), evaluation.KS)


def misses(spark, sf):
    return evaluation.misses(_relevant(spark, sf), _hits(spark, sf, 10), 10, 1_000).select("qid", "text", "top_score")


def coverage(spark, sf):
    c = table(spark, sf, "conversations")
    said = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    before = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return said.join(before, ["conv_id", "turn"]).select("conv_id", "turn", evaluation.coverage(F.col("answer"), F.col("context")).alias("coverage"))


def citations(spark, sf):
    c = table(spark, sf, "conversations")
    body = F.concat("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" [see src/"), F.col("conv_id").cast("string"), F.lit(".md#1] [ ]"))).otherwise(" [1]"), F.lit(f"\n{an.SOURCES_HEADER}\n[9]"))
    cited = evaluation.citations(evaluation.strip_sources(body))
    ids = F.array(F.concat(F.lit("src/"), (F.col("conv_id") - F.col("conv_id") % 2).cast("string"), F.lit(".md")))
    return c.select("conv_id", "turn", F.size(cited).cast("long").alias("n"), evaluation.has_valid_citation(cited, ids).alias("valid"))


def judge_parse(spark, sf):
    c = table(spark, sf, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('So: {"correctness": '), (F.col("conv_id") % 5 + 1).cast("string"), F.lit(', "groundedness": 3, "hallucination": true} done'))).when(F.col("turn") % 3 == 1, "no json").otherwise("{broken")
    j = evaluation.parse_judgement(said)
    return c.select("conv_id", "turn", j["correctness"].alias("correctness"), j["groundedness"].alias("groundedness"), j["hallucination"].alias("hallucination"))


def rag_summary(spark, sf):
    hits = _hits(spark, sf)
    report = evaluation.rag_report(_relevant(spark, sf), hits, an.extractive(asked(spark, sf), hits))
    return evaluation.rag_summary(report).select("n", "hit_rate", "citation_rate", "valid_citation_rate", "coverage", "judged")


def rag_report(spark, sf):
    hits = _hits(spark, sf)
    stub = lambda system, user: '{"correctness": 4, "groundedness": 5, "uses_context": true, "hallucination": false, "short_reason": "ok"}'
    report = evaluation.rag_report(_relevant(spark, sf), hits, an.extractive(asked(spark, sf), hits), stub)
    ids = ("relevant_chunk_ids", "relevant_note_ids", "retrieved_chunk_ids", "retrieved_note_ids")
    said = ("correctness", "groundedness", "uses_context", "hallucination", "short_reason")
    return report.withColumns({c: F.array_join(c, "|") for c in ids} | {c: F.col(f"judge.{c}") for c in said}).drop("judge")


def index_append(spark, sf):
    from quillmesh.sources.store import append_chunks

    chunks_ = one_chunk_notes(spark, sf)
    odd = F.crc32("note_id") % 2 == 1
    index = append_chunks(hybrid.build_index(chunks_.where(odd), CFG), chunks_.where(~odd), CFG)
    return hybrid.retrieve(index, questions(spark, sf), CFG)


def index_saved(spark, sf):
    from quillmesh.sources.store import load_index, save_index, scratch

    path = scratch(spark, "index")
    save_index(hybrid.build_index(one_chunk_notes(spark, sf), CFG, scan=True), path)
    return hybrid.retrieve(load_index(spark, path), questions(spark, sf), CFG)


def jsonl_roundtrip(spark, sf):
    from quillmesh.sources.jsonl import read_chunks, require_rows, write_jsonl
    from quillmesh.sources.store import scratch

    path = scratch(spark, "chunks")
    write_jsonl(one_chunk_notes(spark, sf), path)
    back = require_rows(read_chunks(spark, path), path)
    return back.select("chunk_id", "note_id", "title", "text", F.array_join("tags", "|").alias("tags"), F.array_join("links", "|").alias("links"), "position")


def max_chunks(spark, sf):
    return hybrid.build_index(one_chunk_notes(spark, sf), CFG, max_chunks=50).passages.select("chunk_id", F.size("buckets").alias("tokens"), F.size("terms").alias("terms"))


def get_note(spark, sf):
    made = notes.notes_from_files(markdown(spark, sf))
    return notes.get_note(made, "src/7.md").select("id", "title")


def relevant_ids(spark, sf):
    rows = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("query"),
        F.when(F.col("item_id") % 2 == 0, F.array(F.concat(F.lit("n"), F.col("item_id").cast("string"), F.lit(".md#2")), F.lit(""), F.lit("plain"))).alias("relevant_chunk_ids"),
        F.when(F.col("item_id") % 3 == 0, F.lit("old.md#1")).alias("expected_chunk_id"), F.when(F.col("item_id") % 5 == 0, F.lit("note.md")).alias("expected_note_id"),
    )
    found = evaluation.relevants(rows)
    return found.select("qid", F.array_join("chunk_ids", "|").alias("chunk_ids"), F.array_join("note_ids", "|").alias("note_ids"))


def lsh_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.lsh_topk(e.select(F.col("vec_id").alias("qid"), "embedding"), e, 10)


def yaml_frontmatter(spark, sf):
    md = markdown(spark, sf)
    head = F.concat(F.lit("---\ntitle: 'A "), "lang", F.lit("'\ntags: [x, '#"), "lang", F.lit("']\n---\n"))
    made = notes.notes_from_files(md.withColumn("text", F.concat(head, F.col("text"))))
    return made.select("id", "title", F.array_join("tags", "|").alias("tags"), F.md5("content").alias("content"))


def html_format(spark, sf):
    c = table(spark, sf, "conversations")
    raw = F.concat(F.lit("```py\nif a < b:\n```\n\n\n<b class='x'>`x&y`</b>\n"), F.col("text"))
    return c.select("conv_id", "turn", an.chat_html_of(raw).alias("html"))


def mojibake_fix(spark, sf):
    shown = F.when(F.col("doc_id") % 2 == 0, F.lit("РїСЂРёРІРµС‚")).otherwise(F.substring("text", 1, 40))
    return table(spark, sf, "documents").select("doc_id", an.mojibake_fixed(shown).alias("text"))


def agent_answers(spark, sf):
    from quillmesh.plans.agent import ask

    made = one_chunk_notes(spark, sf)
    held = made.select(F.col("note_id").alias("id"), "title", F.col("text").alias("content"))
    q = questions(spark, sf).withColumn("text", F.when(F.col("qid") % 5 == 0, F.concat(F.lit("open src/"), F.col("qid").cast("string"), F.lit(".md"))).otherwise(F.col("text")))
    out = ask(_index(spark, sf), held, q, CFG)
    return out.select("qid", "answer", F.array_join("tool_calls.name", ",").alias("tools"))


def event_windows(spark, sf):
    from quillmesh.streaming.questions import question_rates

    rates = question_rates(table(spark, sf, "events"))
    return rates.select(F.col("window.start").alias("start"), "event_type", "n", "total")


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_topk, tokens_lex, tokens_embed, hash_buckets, tf_vectors, dense_topk, dense_topk_all, sparse_topk, bm25_stats, bm25_topk, rrf_fusion, tag_boost, link_boost, note_aliases,
        keyword_guard, note_cap_topk, note_title, note_tags, note_links, tag_exclude, sections, clean_text, sentences, chunks, chunk_notes, passages, context_budget,
        sources_text, compact_sources, extractive_answer, plan_route, expand_query, message_split, corpus_counts, recall_mrr, misses, coverage, citations, judge_parse,
        rag_summary, rag_report, relevant_ids, get_note, max_chunks, jsonl_roundtrip, index_saved, index_append, lsh_topk, yaml_frontmatter, html_format, mojibake_fix, agent_answers, event_windows,
    )
}

# SQL, by query

_STOP = ", ".join(f"'{w}'" for w in sorted(tx.STOPWORDS))


def _emb(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_-]+')"


def _lex(c: str) -> str:
    return f"list_filter({_emb(c)}, lambda x: len(x) >= 2 AND x NOT IN ({_STOP}))"


def _bucket(t: str, dim: int = 4096) -> str:
    h = f"md5({t})"
    return f"(('0x' || substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))::BIGINT % {dim})::INTEGER"


_WITH_NOTES = """
c AS (SELECT doc_id, 'src/' || doc_id || '.md' AS note_id, 'src/' || doc_id || '.md#1' AS chunk_id, source || ' ' || doc_id AS title, text, [lang, source] AS tags,
             'src/' || (doc_id + 1) AS link FROM documents),
p AS (SELECT *, trim(title || chr(10) || title || chr(10) || '#' || tags[1] || ' #' || tags[2] || chr(10) || note_id || chr(10) || text, ' ' || chr(10) || chr(9) || chr(13)) AS passage FROM c)"""
_WITH_MD = """
md AS (SELECT 'src/' || doc_id || '.md' AS path, lang, source, doc_id,
    CASE doc_id % 3 WHEN 0 THEN '# Head ' || doc_id || chr(10) WHEN 1 THEN 'lead in' || chr(10) || '###  Deep head ' || chr(10) ELSE '' END
    || '#' || lang || ' and #' || source || '/part-a' || chr(10)
    || '[[src/' || (doc_id + 1) || '| the next ]] [[src/' || (doc_id + 1) || ']] [[Top#Head]]' || chr(10) || text
    || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '## Tail' || chr(10) || '- one **two** three' || chr(10) || '2. four' || chr(10) || '#not a head' || chr(10) || '## ' || chr(10) || 'last. Words!' ELSE '' END AS text
    FROM documents)"""
_WITH_Q = """
q AS (SELECT item_id AS qid, text || CASE item_id % 3 WHEN 0 THEN ' #en' WHEN 1 THEN ' #src1 #EN #src1' ELSE '' END AS text FROM benchmark)"""


def _vector_leg(items_: str, key: str, text: str, queries: str, k: int) -> str:
    """CTE ``vec`` (qid, key, score, rank) of hashing vectors, every pair scored."""
    return f"""
ib AS (SELECT {key}, {_bucket('t')} AS b, count(*) AS tf FROM (SELECT {key}, unnest({_emb(text)}) AS t FROM {items_}) GROUP BY ALL),
iv AS (SELECT {key}, b, tf / (sqrt(sum(tf * tf) OVER (PARTITION BY {key})) + 1e-12) AS w FROM ib),
qb AS (SELECT qid, {_bucket('t')} AS b, count(*) AS tf FROM (SELECT qid, unnest({_emb('text')}) AS t FROM {queries}) GROUP BY ALL),
qv AS (SELECT qid, b, tf / (sqrt(sum(tf * tf) OVER (PARTITION BY qid)) + 1e-12) AS w FROM qb),
dots AS (SELECT qid, {key}, round(sum(iv.w * qv.w), 6) AS s FROM iv JOIN qv USING (b) GROUP BY ALL),
vec AS (SELECT * FROM (SELECT qid, {key}, coalesce(s, 0.0) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(s, 0.0) DESC, {key}) AS rank
        FROM (SELECT qid FROM {queries}) CROSS JOIN (SELECT {key} FROM {items_}) LEFT JOIN dots USING (qid, {key})) WHERE rank <= {k})"""


def _bm25_leg(items_: str, key: str, text: str, queries: str, k: int) -> str:
    """CTEs ``idf`` (term, df, idf), ``qt`` (qid, term, nth) and ``bm`` (qid, key, score, rank)."""
    return f"""
it AS (SELECT {key}, {_lex(text)} AS toks FROM {items_}),
size AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM it),
post AS (SELECT term, {key}, count(*) AS tf FROM (SELECT {key}, unnest(toks) AS term FROM it) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, size GROUP BY term),
qt AS (SELECT qid, term, min(nth) AS nth FROM (SELECT qid, unnest(toks) AS term, generate_subscripts(toks, 1) AS nth FROM (SELECT qid, {_lex('text')} AS toks FROM {queries})) GROUP BY ALL),
gains AS (SELECT qid, {key}, nth, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(len(toks), 1) / avgdl)) AS g
          FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN it USING ({key}), size),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, nth, {key}) AS rank
       FROM (SELECT qid, {key}, round(sum(g), 6) AS score, min(nth) AS nth FROM gains GROUP BY ALL)) WHERE rank <= {k})"""


_FUSED = f"""
{_WITH_NOTES}, {_WITH_Q}, {_vector_leg('p', 'note_id', 'passage', 'q', 40)}, {_bm25_leg('p', 'note_id', 'passage', 'q', 40)},
legs AS (SELECT qid, note_id, rank, rank AS seen FROM vec UNION ALL SELECT qid, note_id, rank, 1000000 + rank FROM bm),
fused AS (SELECT qid, note_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, min(seen) AS seen FROM legs GROUP BY ALL)"""
_ALIASES = """
al AS (SELECT alias, arg_min(note_id, note_id || kind) AS note_id FROM (
    SELECT note_id, 0 AS kind, lower(note_id) AS alias FROM c UNION ALL SELECT note_id, 1, lower(replace(note_id, '.md', '')) FROM c
    UNION ALL SELECT note_id, 2, doc_id::VARCHAR FROM c UNION ALL SELECT note_id, 3, lower(title) FROM c) GROUP BY alias)"""
_RELATED = f"""{_ALIASES},
related AS (SELECT DISTINCT qid, al.note_id FROM vec JOIN c ON c.note_id = vec.note_id JOIN al ON al.alias = lower(c.link) WHERE rank <= 10)"""
_KEYWORDS = """
kw AS (SELECT qid, term, nth FROM (SELECT qid, term, nth, row_number() OVER (PARTITION BY qid ORDER BY qt.nth) AS n FROM qt LEFT JOIN idf USING (term)
       WHERE regexp_matches(term, '[a-z0-9]') OR coalesce(idf, 0) >= 1.5) WHERE n <= 8)"""
_QTAGS = r"""
qtags AS (SELECT DISTINCT qid, lower(t) AS tag FROM (SELECT qid, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])#([\p{L}\p{N}_/-]+)', 1)) AS t FROM q))"""

_HITS3 = f"""
i AS (SELECT doc_id AS item, text FROM documents), q AS (SELECT item_id AS qid, text FROM benchmark), {_bm25_leg('i', 'item', 'text', 'q', 3)},
h AS (SELECT qid, rank, score, 'src/' || item || '.md#1' AS chunk_id, 'src/' || item || '.md' AS note_id, source || ' ' || item AS title, source || ' ' || item AS section, d.text
      FROM bm JOIN documents d ON d.doc_id = bm.item)"""
_HITS10 = _HITS3.replace("WHERE rank <= 3", "WHERE rank <= 10")
_REL = """
rel AS (SELECT item_id AS qid, 'src/' || doc_id || '.md' AS note_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
firsts AS (SELECT b.item_id AS qid, min(h.rank) FILTER (WHERE rel.note_id IS NOT NULL) AS r FROM benchmark b LEFT JOIN h ON h.qid = b.item_id
           LEFT JOIN rel ON rel.qid = h.qid AND rel.note_id = h.note_id GROUP BY 1)"""
_ANSWER = f"""
src AS (SELECT qid, chr(10) || '{an.SOURCES_HEADER}' || chr(10) || string_agg(rank || ') ' || note_id || ' (' || chunk_id || ') — ' || title || ' → ' || section, chr(10) ORDER BY rank) AS sources FROM h GROUP BY qid),
body AS (SELECT qid, string_agg(rank || ') [' || title || ' -> ' || section || '] (score=' || printf('%.3f', score) || ')' || chr(10) || text || chr(10)
         || '   source: ' || note_id || ' (' || chunk_id || ')' || chr(10), chr(10) ORDER BY rank) AS body FROM h GROUP BY qid),
ans AS (SELECT q.qid, CASE WHEN body IS NULL THEN '{an.NO_HITS}' ELSE
        trim('Question: ' || q.text || chr(10) || chr(10) || 'Answer (baseline, retrieval-only):' || chr(10) || chr(10) || body, ' ' || chr(10)) || sources END AS answer
        FROM q LEFT JOIN body USING (qid) LEFT JOIN src USING (qid))"""

_SENTENCES = r"list_filter(regexp_extract_all(flat, '(.+?[…?!.]+)(?:\s+|$)', 1) || [trim(regexp_replace(flat, '(.+?[…?!.]+)(?:\s+|$)', '', 'g'))], lambda x: x <> '')"


def _clean(c: str) -> str:
    for pattern, to in ((r"(?m)^\s*#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), ("[_*`]{2,}", " "), (r"\s+", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim({c})"


def _wordcount(s: str) -> str:
    return f"len(string_split({s}, ' '))"


def _packed(source: str, key: str, text: str) -> str:
    """CTE ``packed`` (key columns, cs): the chunks of each text, by a fold over its sentences."""
    return f"""
flat AS (SELECT {key}, {_clean(text)} AS flat FROM {source}),
sent AS (SELECT {key}, {_SENTENCES} AS ss FROM flat),
state AS (SELECT {key}, list_reduce(list_prepend({{'out': []::VARCHAR[], 'cur': NULL::VARCHAR, 'n': 0::BIGINT, 's': NULL::VARCHAR}},
    list_transform(ss, lambda x: {{'out': []::VARCHAR[], 'cur': NULL::VARCHAR, 'n': 0::BIGINT, 's': x}})),
    lambda a, e: CASE
      WHEN {_wordcount('e.s')} >= 300 THEN {{'out': CASE WHEN a.cur IS NULL THEN a.out ELSE a.out || [a.cur] END || [e.s], 'cur': NULL::VARCHAR, 'n': 0::BIGINT, 's': NULL::VARCHAR}}
      WHEN a.n + {_wordcount('e.s')} <= 300 THEN {{'out': a.out, 'cur': CASE WHEN a.cur IS NULL THEN e.s ELSE a.cur || ' ' || e.s END, 'n': (a.n + {_wordcount('e.s')})::BIGINT, 's': NULL::VARCHAR}}
      WHEN a.cur IS NULL THEN {{'out': a.out, 'cur': e.s, 'n': {_wordcount('e.s')}::BIGINT, 's': NULL::VARCHAR}}
      ELSE {{'out': a.out || [a.cur], 'cur': array_to_string(string_split(a.cur, ' ')[-60:], ' ') || ' ' || e.s, 'n': (least(60, {_wordcount('a.cur')}) + {_wordcount('e.s')})::BIGINT, 's': NULL::VARCHAR}}
    END) AS st FROM sent),
packed AS (SELECT {key}, CASE WHEN st.cur IS NULL THEN st.out ELSE st.out || [st.cur] END AS cs FROM state)"""


_TITLE = "CASE doc_id % 3 WHEN 0 THEN 'Head ' || doc_id WHEN 1 THEN 'Deep head' ELSE lang || ' and #' || source || '/part-a' END"
_SECTIONS = rf"""{_WITH_MD}, l AS (SELECT path, {_TITLE} AS title, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM md),
m AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s') AS head, sum(regexp_matches(line, '^#{{1,6}}\s')::INTEGER) OVER (PARTITION BY path ORDER BY pos) AS sec FROM l),
g AS (SELECT path, title, sec, max(line) FILTER (WHERE head) AS head, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT head), ''), ' ' || chr(10)) AS text, max(sec) OVER (PARTITION BY path) AS last FROM m GROUP BY path, title, sec),
secs AS (SELECT path, title, sec, text, CASE WHEN head IS NOT NULL THEN coalesce(nullif(trim(regexp_replace(head, '^#+', '')), ''), 'Section') WHEN last > 0 THEN 'Introduction' END AS section FROM g WHERE text <> '')"""
_SPLIT = """
s AS (SELECT doc_id, text, list_reduce(list_prepend({'out': []::VARCHAR[], 'cur': ''::VARCHAR}, list_transform(string_split(text, chr(10)), lambda x: {'out': []::VARCHAR[], 'cur': x})),
    lambda a, e: CASE WHEN length(a.cur) + length(e.cur) + 1 > 1000 THEN {'out': CASE WHEN a.cur = '' THEN a.out ELSE a.out || [trim(a.cur, ' ' || chr(10))] END, 'cur': e.cur}
    ELSE {'out': a.out, 'cur': CASE WHEN a.cur = '' THEN e.cur ELSE a.cur || chr(10) || e.cur END} END) AS st FROM documents),
w AS (SELECT doc_id, CASE WHEN length(text) <= 1000 THEN [text] WHEN st.cur = '' THEN st.out ELSE st.out || [trim(st.cur, ' ' || chr(10))] END AS ps FROM s)"""

ORACLES = {
    "tokens_lex": f"SELECT token, count(*) AS n FROM (SELECT unnest({_lex('text')}) AS token FROM documents) GROUP BY token",
    "tokens_embed": f"SELECT token, count(*) AS n FROM (SELECT unnest({_emb('text')}) AS token FROM documents) GROUP BY token",
    "hash_buckets": f"SELECT doc_id, {_bucket('t')} AS bucket, count(*) AS tf FROM (SELECT doc_id, unnest({_emb('text')}) AS t FROM documents) GROUP BY ALL",
    "tf_vectors": f"WITH b AS (SELECT doc_id, {_bucket('t')} AS bucket, count(*) AS tf FROM (SELECT doc_id, unnest({_emb('text')}) AS t FROM documents) GROUP BY ALL) SELECT doc_id, bucket, round(tf / (sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) + 1e-12), 6) AS w FROM b",
    "dense_topk": "SELECT * FROM (SELECT q.vec_id AS qid, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id)::INTEGER AS rank FROM embeddings q, embeddings e WHERE q.vec_id < 20) WHERE rank <= 10",
    "dense_topk_all": "SELECT * FROM (SELECT q.vec_id AS qid, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id)::INTEGER AS rank FROM embeddings q, embeddings e) WHERE rank <= 10",
    "sparse_topk": f"WITH i AS (SELECT doc_id AS item, text FROM documents), q AS (SELECT item_id AS qid, text FROM benchmark), {_vector_leg('i', 'item', 'text', 'q', 10)} SELECT qid, item, score, rank::INTEGER AS rank FROM vec",
    "bm25_stats": f"WITH i AS (SELECT doc_id AS item, text FROM documents), q AS (SELECT item_id AS qid, text FROM benchmark), {_bm25_leg('i', 'item', 'text', 'q', 10)} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH i AS (SELECT doc_id AS item, text FROM documents), q AS (SELECT item_id AS qid, text FROM benchmark), {_bm25_leg('i', 'item', 'text', 'q', 10)} SELECT qid, item, score, rank::INTEGER AS rank FROM bm",
    "rrf_fusion": f"WITH {_FUSED} SELECT qid, note_id || '#1' AS chunk_id, rrf FROM fused",
    "tag_boost": f"WITH {_WITH_NOTES}, {_WITH_Q}, {_QTAGS} SELECT qid, chunk_id, round(0.35::DOUBLE * count(*), 6) AS boost FROM qtags JOIN c ON list_contains(c.tags, qtags.tag) GROUP BY ALL",
    "link_boost": f"WITH {_FUSED}, {_RELATED} SELECT qid, note_id FROM related",
    "note_aliases": f"WITH {_WITH_NOTES}, {_ALIASES} SELECT alias, note_id FROM al",
    "keyword_guard": f"WITH {_WITH_NOTES}, {_WITH_Q}, {_bm25_leg('p', 'note_id', 'passage', 'q', 40)}, {_KEYWORDS} SELECT qid, string_agg(term, ' ' ORDER BY nth) AS keywords FROM kw GROUP BY qid",
    "note_cap_topk": f"""WITH i AS (SELECT doc_id AS item, text FROM documents), q AS (SELECT item_id AS qid, text FROM benchmark), {_vector_leg('i', 'item', 'text', 'q', 40)},
        n AS (SELECT qid, item, source AS note_id, score, vec.rank AS r, row_number() OVER (PARTITION BY qid, source ORDER BY vec.rank) AS nth FROM vec JOIN documents ON doc_id = item)
        SELECT * FROM (SELECT qid, item, note_id, score, row_number() OVER (PARTITION BY qid ORDER BY r)::INTEGER AS rank FROM n WHERE nth <= 2) WHERE rank <= 5""",
    "hybrid_topk": f"""WITH {_FUSED}, {_RELATED}, {_KEYWORDS}, {_QTAGS},
        ov AS (SELECT kw.qid, post.note_id, count(*) AS k FROM kw JOIN post USING (term) GROUP BY ALL),
        nk AS (SELECT qid, count(*) AS nk FROM kw GROUP BY qid),
        tg AS (SELECT qid, note_id, count(*) AS t FROM qtags JOIN c ON list_contains(c.tags, qtags.tag) GROUP BY ALL),
        s AS (SELECT f.qid, f.note_id, rrf, seen, round(rrf + 0.35 * coalesce(t, 0) + CASE WHEN r.note_id IS NOT NULL THEN 0.1 ELSE 0 END
              + CASE WHEN coalesce(nk, 0) = 0 THEN 0 WHEN coalesce(k, 0) = 0 THEN -1.0 ELSE 0.15 * k END, 6)::DOUBLE AS score
              FROM fused f LEFT JOIN tg USING (qid, note_id) LEFT JOIN related r ON r.qid = f.qid AND r.note_id = f.note_id LEFT JOIN nk ON nk.qid = f.qid LEFT JOIN ov ON ov.qid = f.qid AND ov.note_id = f.note_id),
        t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rrf DESC, seen)::INTEGER AS rank FROM s)
        SELECT qid, rank, score, chunk_id, note_id, title, title AS section, text FROM t JOIN c USING (note_id) WHERE rank <= 5""",
    "note_title": f"WITH {_WITH_MD} SELECT path AS id, {_TITLE} AS title FROM md",
    "note_tags": rf"""WITH {_WITH_MD}, t AS (SELECT path, unnest(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])#([\p{{L}}\p{{N}}_/-]+)', 1)) AS t FROM md)
        SELECT path AS id, string_agg(DISTINCT t, '|' ORDER BY t) AS tags FROM t GROUP BY path""",
    "note_links": f"WITH {_WITH_MD} SELECT path AS id, 'src/' || (doc_id + 1) || '|Top#Head' AS links FROM md",
    "tag_exclude": "SELECT 'src/' || doc_id || '.md' AS id FROM documents WHERE lang <> 'en' AND source <> 'src3'",
    "sections": f"WITH {_SECTIONS} SELECT path, (row_number() OVER (PARTITION BY path ORDER BY sec) - 1)::INTEGER AS nth, coalesce(section, path) AS section, text FROM secs",
    "chunk_notes": f"""WITH {_SECTIONS}, {_packed('secs', 'path, title, sec, section', 'text')}, each AS (SELECT path, title, sec, section, unnest(cs) AS text, generate_subscripts(cs, 1) AS i FROM packed),
        n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY sec, i)::INTEGER AS position FROM each)
        SELECT path || '#' || position AS chunk_id, path AS note_id, title, coalesce(section, title) AS section, text, position FROM n""",
    "message_split": f"WITH {_SPLIT} SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INTEGER AS part, unnest(ps) AS piece FROM w",
    "clean_text": f"WITH {_WITH_MD} SELECT path, {_clean('text')} AS text FROM md",
    "sentences": rf"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents), s AS (SELECT doc_id, {_SENTENCES} AS ss FROM f) SELECT doc_id, (generate_subscripts(ss, 1) - 1)::INTEGER AS nth, unnest(ss) AS sentence FROM s",
    "chunks": f"WITH {_packed('documents', 'doc_id', 'text')} SELECT doc_id, (generate_subscripts(cs, 1) - 1)::INTEGER AS nth, unnest(cs) AS chunk FROM packed",
    "passages": f"WITH {_WITH_NOTES} SELECT chunk_id, passage FROM p",
    "context_budget": f"""WITH {_HITS3}, b AS (SELECT qid, rank::INTEGER AS rank, length('[Source ' || rank || ']' || 'note_id: ' || note_id || 'chunk_id: ' || chunk_id || 'title: ' || title || 'section: ' || section || 'text: ' || text) + 6 AS chars FROM h),
        u AS (SELECT *, sum(chars) OVER (PARTITION BY qid ORDER BY rank) AS upto FROM b) SELECT qid, rank, chars::INTEGER AS chars, upto::BIGINT AS upto FROM u WHERE upto <= 12000""",
    "sources_text": f"WITH {_HITS3}, {_ANSWER} SELECT qid, sources FROM src",
    "compact_sources": f"WITH {_HITS3} SELECT qid, chr(10) || '<b>📚 Источники:</b>' || chr(10) || string_agg(rank || ') ' || title || ' → ' || section, chr(10) ORDER BY rank) AS sources FROM h WHERE rank <= 2 GROUP BY qid",
    "extractive_answer": f"WITH {_HITS3}, {_ANSWER} SELECT qid, answer FROM ans",
    "plan_route": "SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'get_note' ELSE 'search' END AS tool, CASE WHEN item_id % 2 = 0 THEN 'src/' || item_id || '.md' END AS note_id, CASE WHEN item_id % 2 = 1 THEN 5 END AS k FROM benchmark",
    "expand_query": rf"""WITH t AS (SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] WHEN 1 THEN '?! ...' ELSE text END AS text FROM benchmark),
        b AS (SELECT qid, text, trim(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM t)
        SELECT qid, CASE WHEN bare = '' THEN text WHEN len(string_split(bare, ' ')) < 3 THEN bare || ' {an.NOTE_MARKER}' ELSE bare END AS expanded FROM b""",
    "corpus_counts": "SELECT count(*) AS chunks, count(DISTINCT doc_id) AS notes FROM documents",
    "recall_mrr": f"""WITH {_HITS10}, {_REL}, k AS (SELECT unnest([1, 3, 5, 10])::INTEGER AS k), m AS (SELECT k, round(avg(CASE WHEN r <= k THEN 1.0::DOUBLE ELSE 0 END), 6) AS rec, round(avg(CASE WHEN r <= k THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS mrr FROM firsts, k GROUP BY k)
        SELECT k, rec AS recall_chunk, mrr AS mrr_chunk, rec AS recall_note, mrr AS mrr_note FROM m""",
    "misses": f"WITH {_HITS10}, {_REL} SELECT b.item_id AS qid, b.text, coalesce(h.score, -999.0) AS top_score FROM benchmark b JOIN firsts f ON f.qid = b.item_id AND f.r IS NULL LEFT JOIN h ON h.qid = b.item_id AND h.rank = 1",
    "coverage": f"""WITH p AS (SELECT a.conv_id, a.turn, {_lex('a.text')} AS said, {_lex('u.text')} AS known FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn + 1 = a.turn WHERE a.role = 'assistant' AND u.role = 'user')
        SELECT conv_id, turn, CASE WHEN len(said) = 0 THEN 0.0 ELSE round(len(list_filter(said, lambda t: list_contains(known, t)))::DOUBLE / len(said), 6) END AS coverage FROM p""",
    "citations": r"SELECT conv_id, turn, (len(regexp_extract_all(text, '\[([^\]]*[^\]\s][^\]]*)\]')) + 1)::BIGINT AS n, turn % 2 = 0 AND conv_id % 2 = 0 AS valid FROM conversations",
    "judge_parse": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN (conv_id % 5 + 1)::DOUBLE END AS correctness, CASE WHEN turn % 3 = 0 THEN 3.0::DOUBLE END AS groundedness, CASE WHEN turn % 3 = 0 THEN true END AS hallucination FROM conversations",
    "rag_summary": rf"""WITH {_HITS3}, {_ANSWER}, ctx AS (SELECT qid, string_agg(text, chr(10) ORDER BY rank) AS context, list(chunk_id) || list(note_id) AS ids FROM h GROUP BY qid),
        b AS (SELECT ans.qid, trim(split_part(answer, '{an.SOURCES_HEADER}', 1), ' ' || chr(10)) AS body, context, coalesce(ids, []) AS ids FROM ans LEFT JOIN ctx USING (qid)),
        s AS (SELECT *, {_lex('body')} AS said, {_lex("coalesce(context, '')")} AS known, list_filter(list_transform(regexp_extract_all(body, '\[([^\]]+)\]', 1), lambda x: trim(x)), lambda x: x <> '') AS cited FROM b)
        SELECT count(*) AS n, round(avg(CASE WHEN len(ids) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, round(avg(CASE WHEN len(cited) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS citation_rate,
        round(avg(CASE WHEN len(list_filter(cited, lambda x: len(list_filter(ids, lambda y: contains(x, y))) > 0)) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS valid_citation_rate,
        round(avg(CASE WHEN len(said) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(said, lambda t: list_contains(known, t)))::DOUBLE / len(said), 6) END), 6) AS coverage, 0::BIGINT AS judged FROM s""",
    "event_windows": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
}
ORACLES["index_append"] = ORACLES["index_saved"] = ORACLES["hybrid_topk"]
ORACLES |= {
    "jsonl_roundtrip": f"WITH {_WITH_NOTES} SELECT chunk_id, note_id, title, text, tags[1] || '|' || tags[2] AS tags, link AS links, 1::INTEGER AS position FROM c",
    "max_chunks": f"WITH {_WITH_NOTES} SELECT chunk_id, len({_emb('passage')})::INTEGER AS tokens, len({_lex('passage')})::INTEGER AS terms FROM p ORDER BY note_id LIMIT 50",
    "get_note": f"WITH {_WITH_MD} SELECT path AS id, {_TITLE} AS title FROM md WHERE path = 'src/7.md'",
    "relevant_ids": """SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'n' || item_id || '.md#2|plain' WHEN item_id % 3 = 0 THEN 'old.md#1' ELSE '' END AS chunk_ids,
        CASE WHEN item_id % 5 = 0 THEN 'note.md' WHEN item_id % 2 = 0 THEN 'n' || item_id || '.md' WHEN item_id % 3 = 0 THEN 'old.md' ELSE '' END AS note_ids FROM benchmark""",
}
ORACLES |= {
    "yaml_frontmatter": rf"""WITH {_WITH_MD}, t AS (SELECT path, unnest(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])#([\p{{L}}\p{{N}}_/-]+)', 1) || ['x', lang]) AS t FROM md)
        SELECT path AS id, 'A ' || any_value(lang) AS title, string_agg(DISTINCT t, '|' ORDER BY t) AS tags, md5(any_value(text)) AS content FROM t JOIN md USING (path) GROUP BY path""",
    "html_format": """SELECT conv_id, turn, '<pre><code>if a &lt; b:</code></pre>' || chr(10) || chr(10) || '<b><code>x&amp;y</code></b>' || chr(10)
        || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM conversations""",
    "mojibake_fix": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'привет' ELSE substring(text, 1, 40) END AS text FROM documents",
    "rag_report": rf"""WITH {_HITS3}, {_REL}, {_ANSWER}, ctx AS (SELECT qid, string_agg(text, chr(10) ORDER BY rank) AS context, list(chunk_id ORDER BY rank) AS chunk_ids, list(note_id ORDER BY rank) AS note_ids FROM h GROUP BY qid),
        want AS (SELECT qid, string_agg(note_id || '#1', '|' ORDER BY note_id || '#1') AS chunk_ids, string_agg(note_id, '|' ORDER BY note_id || '#1') AS note_ids FROM rel GROUP BY qid),
        b AS (SELECT q.qid, q.text AS query, answer, trim(split_part(answer, '{an.SOURCES_HEADER}', 1), ' ' || chr(10)) AS body, coalesce(context, '') AS context, coalesce(chunk_ids, []) AS c, coalesce(note_ids, []) AS n
              FROM q JOIN ans USING (qid) LEFT JOIN ctx USING (qid)),
        s AS (SELECT *, {_lex('body')} AS said, {_lex('context')} AS known, list_filter(list_transform(regexp_extract_all(body, '\[([^\]]+)\]', 1), lambda x: trim(x)), lambda x: x <> '') AS cited FROM b)
        SELECT query, coalesce(want.chunk_ids, 'none.md#1') AS relevant_chunk_ids, coalesce(want.note_ids, 'none.md') AS relevant_note_ids, array_to_string(c, '|') AS retrieved_chunk_ids, array_to_string(n, '|') AS retrieved_note_ids,
        answer, body AS answer_body, CASE WHEN len(said) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(said, lambda t: list_contains(known, t)))::DOUBLE / len(said), 6) END AS coverage,
        len(cited) > 0 AS has_bracket_citations, len(list_filter(cited, lambda x: len(list_filter(c || n, lambda y: contains(x, y))) > 0)) > 0 AS has_valid_bracket_citation,
        4.0::DOUBLE AS correctness, 5.0::DOUBLE AS groundedness, true AS uses_context, false AS hallucination, 'ok' AS short_reason FROM s LEFT JOIN want USING (qid)""",
}
