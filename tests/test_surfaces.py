from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quillmesh.config import CHUNK, HIT, NOTE, VALIDATION, RetrievalConfig
from quillmesh.operators import answers as an
from quillmesh.operators import evaluation as ev
from quillmesh.plans import hybrid
from quillmesh.plans.agent import ask
from quillmesh.sources import jsonl, llm, store, vault
from quillmesh.streaming import questions as st

HITS = [(1, 1, 0.5, "a.md#1", "a.md", "A <t>", "S & s", "first text"), (1, 2, 0.25, "b.md#1", "b.md", "B", "s", "second text"), (2, 1, -0.1, "c.md#1", "c.md", "C" * 60, "x" * 40, "third")]


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame(HITS, HIT)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "what"), (2, "who"), (3, "none")], "qid long, text string")


def by_qid(df, col):
    return {r.qid: r[col] for r in df.collect()}


def test_sources_and_context(hits):
    s = by_qid(an.sources_block(hits), "sources")
    assert s[1] == f"\n{an.SOURCES_HEADER}\n1) a.md (a.md#1) — A &lt;t&gt; → S &amp; s\n2) b.md (b.md#1) — B → s" and 3 not in s
    block = "[Source 1]\nnote_id: a.md\nchunk_id: a.md#1\ntitle: A <t>\nsection: S & s\ntext: first text\n"
    assert by_qid(an.llm_context(hits, len(block)), "context")[1] == block.strip()
    assert 1 not in by_qid(an.llm_context(hits, len(block) - 1), "context")
    full = by_qid(an.llm_context(hits), "context")[1]
    assert full.startswith(block + "\n[Source 2]") and not full.endswith("\n")
    short = by_qid(an.compact_sources(hits, 1), "sources")
    assert short[2].endswith("1) " + "C" * 50 + "... → " + "x" * 30 + "...") and short[1].count("\n") == 2


def test_answers(hits, asked):
    plain = by_qid(an.extractive(asked, hits), "answer")
    assert plain[3] == an.NO_HITS and plain[1].startswith("Question: what\n\nAnswer (baseline, retrieval-only):\n\n1) [A <t> -> S & s] (score=0.500)\nfirst text\n   source: a.md (a.md#1)\n\n2) [B")

    def chat(system, user):
        if "who" in user:
            raise RuntimeError
        return f" said {len(user)} "

    told = by_qid(an.answer(asked, hits, "llm", chat), "answer")
    assert told[1].startswith("said ") and an.SOURCES_HEADER in told[1] and told[2] == plain[2] and told[3] == an.NO_HITS
    assert by_qid(an.answer(asked, hits, "llm", None), "answer") == plain == by_qid(an.answer(asked, hits, " Baseline"), "answer")


def test_routing_and_expansion(spark):
    texts = ["open x/y.md please", 'open "a.md"', "открой b.MD", "what is a.md", "покажи (n\\m.md", "open .md", None]
    df = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    got = {r.qid: (r.tool, r.note_id, r.k) for r in an.route(df, 7).collect()}
    assert got[0] == ("get_note", "x/y.md", None) and got[1] == ("search", None, 7) and got[2][1] == "b.MD" and got[3][0] == "search" and got[4][1] == "n/m.md" and got[6][0] == "search"
    more = spark.createDataFrame([(1, "a, b!"), (2, "one two three?"), (3, "?!"), (4, "x-y z w")], "qid long, text string")
    assert by_qid(more.select("qid", an.expand_query(F.col("text")).alias("e")), "e") == {1: f"a b {an.NOTE_MARKER}", 2: "one two three", 3: "?!", 4: "x y z w"}


def plain_split(text, most):
    if len(text) <= most:
        return [text]
    out, cur = [], ""
    rest = text.split("\n")
    while rest:
        one = rest.pop(0)
        if len(cur) + len(one) >= most:
            out += [cur.strip()] if cur else []
            cur = one
        else:
            cur = cur + "\n" + one if cur else one
    return out + ([cur.strip()] if cur else [])


def test_messages(spark):
    texts = ["short", "a\nbb\nccc\ndddd\n" * 4, "x" * 50 + "\ny", "\n\n" + "q\n" * 20, "", "12345\n67890"]
    df = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    got = {}
    for r in sorted(an.split_message(df, most=10).collect(), key=lambda r: (r.qid, r.part)):
        got.setdefault(r.qid, []).append(r.piece)
    assert got == {k: plain_split(t, 10) for k, t in enumerate(texts)}


def test_presentation():
    assert an.chat_html("```py\na<b\n```\n\n\n\n<i x='1'>`c&d`</i> \n") == "<pre><code>a&lt;b</code></pre>\n\n<i><code>c&amp;d</code></i>"
    assert an.chat_html(None) is None
    broken = "привет".encode().decode("cp1251")
    assert an.fix_mojibake(broken) == "привет" and an.fix_mojibake("plain") == "plain" and an.fix_mojibake("Россия") == "Россия" and an.fix_mojibake("") == ""


def test_counts(spark):
    chunks = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "note_id string")
    assert tuple(an.corpus_counts(chunks).first()) == (4, 1)
    assert tuple(an.corpus_counts(chunks.where("note_id = ''"), spark.range(7)).first()) == (1, 7)


def test_relevants_and_metrics(spark, hits):
    rows = [(1, "q", ["b.md#1"], None, None, None), (2, "q", None, None, "zz", None), (3, None, None, ["c.md"], None, None), (4, "q", ["", None], None, "a.md#2", "n.md")]
    v = spark.createDataFrame(rows, "qid long, " + VALIDATION)
    rel = {r.qid: (r.chunk_ids, r.note_ids) for r in ev.relevants(v).collect()}
    assert rel == {1: (["b.md#1"], ["b.md"]), 2: (["zz"], []), 3: ([], ["c.md"]), 4: (["a.md#2"], ["n.md"])}
    assert {r.qid: r.note_ids for r in ev.relevants(v, lenient=True).collect()}[2] == ["zz"]
    firsts = ev.first_ranks(ev.relevants(v), hits)
    assert {r.qid: (r.chunk_rank, r.note_rank) for r in firsts.collect()} == {1: (2, 2), 2: (None, None), 3: (None, None), 4: (None, None)}
    m = {r.k: tuple(r)[1:] for r in ev.retrieval_metrics(firsts, [3, 1, 1, 0]).collect()}
    assert m == {1: (0.0, 0.0, 0.0, 0.0), 3: (0.25, 0.125, 0.25, 0.125)}
    lost = [(r.qid, r.top_score) for r in ev.misses(ev.relevants(v), hits, 3).collect()]
    assert lost == [(2, -0.1), (3, -999.0), (4, -999.0)]
    assert ev.misses(ev.relevants(v), hits, 3, show=1).count() == 1


def test_answer_metrics(spark):
    df = spark.createDataFrame([("Cat cat dog the", "a cat", "x [a.md#1] [ ] [2]" + f"\n{an.SOURCES_HEADER}\n[9]")], "a string, c string, t string")
    r = df.select(ev.coverage(F.col("a"), F.col("c")).alias("cov"), ev.citations(ev.strip_sources(F.col("t"))).alias("cit"), ev.coverage(F.lit("the"), F.col("c")).alias("none")).first()
    assert r.cov == 0.666667 and r.cit == ["a.md#1", "2"] and r.none == 0.0
    said = ['ok {"correctness": 4, "hallucination": true} end', "none", "{bad", "{}", None, '{"groundedness": 2.5}']
    got = [r.j for r in spark.createDataFrame([(s,) for s in said], "t string").select(ev.parse_judgement(F.col("t")).alias("j")).collect()]
    assert got[0].correctness == 4.0 and got[0].hallucination and got[1:5] == [None] * 4 and got[5].groundedness == 2.5


def test_report(spark, hits, asked):
    v = ev.relevants(spark.createDataFrame([(1, "what", ["a.md#1"]), (2, "who", ["q.md#1"]), (3, "none", ["r.md#1"])], "qid long, query string, relevant_chunk_ids array<string>"))
    answers = spark.createDataFrame([(1, "first text [a.md]"), (2, "made up [7]"), (3, an.NO_HITS)], "qid long, answer string")
    report = ev.rag_report(v, hits, answers, lambda s, u: '{"correctness": 5, "groundedness": 3, "hallucination": true}' if "what" in u else "no").cache()
    assert len(report.columns) == 11
    s = ev.rag_summary(report).first()
    assert (s.n, s.hit_rate, s.citation_rate, s.valid_citation_rate, s.judged, s.correctness, s.hallucination_rate) == (3, 0.666667, 0.666667, 0.333333, 1, 5.0, 1.0)
    assert ev.rag_k_list(4) == [1, 3] and ev.rag_k_list(10) == [1, 3, 5, 10] and ev.rag_k_list(0) == []


def test_vault(spark, tmp_path):
    for path, text in (("a.md", "# A\n#x"), ("sub/B.MD", "b #y"), (".hid/_c.md", "c"), ("skip/d.md", "d"), ("sub/skip/e.md", "e"), ("n.txt", "no")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r.id: r for r in vault.read_vault(spark, str(tmp_path), ["skip"], ["y"]).collect()}
    assert set(got) == {"a.md", ".hid/_c.md"} and got["a.md"].title == "A"
    assert time.strptime(got["a.md"].modified, "%Y-%m-%dT%H:%M:%S") and got["a.md"].created
    (tmp_path / "none").mkdir()
    assert vault.read_vault(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        vault.read_vault(spark, str(tmp_path / "missing"))


def test_jsonl(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('{"id": "a", "extra": 1}\n\n  \n{"id": "ж", "tags": ["x"], "title": null}\n')
    notes = jsonl.read_notes(spark, str(tmp_path / "n.jsonl"))
    assert sorted((r.id, r.tags) for r in notes.collect()) == [("a", None), ("ж", ["x"])]
    jsonl.write_jsonl(notes.coalesce(1), str(tmp_path / "out"))
    lines = [json.loads(x) for f in os.listdir(tmp_path / "out") if f.startswith("part") for x in open(tmp_path / "out" / f, encoding="utf-8")]
    assert all(set(x) == set(c.split()[0] for c in NOTE.split(", ")) for x in lines) and any(x["id"] == "ж" for x in lines)
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_notes(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(ValueError):
        jsonl.require_rows(notes.limit(0), "notes")


def small_chunks(spark, start, end):
    return spark.createDataFrame([(f"n{k}.md#1", f"n{k}.md", f"T{k}", "s", f"text about topic{k} and shared", ["t"], [f"n{k + 1}"], 1) for k in range(start, end)], CHUNK)


def test_saved_index_and_append(spark, tmp_path):
    cfg, path = RetrievalConfig(), str(tmp_path / "index")
    q = spark.createDataFrame([(1, "topic3 shared"), (2, "topic8")], "qid long, text string")
    whole = hybrid.build_index(small_chunks(spark, 0, 10), cfg)
    want = sorted(map(tuple, hybrid.retrieve(whole, q, cfg).collect()))
    with pytest.raises(FileNotFoundError):
        store.load_index(spark, path)
    store.save_index(hybrid.build_index(small_chunks(spark, 0, 4), cfg), path)
    grown = store.append_chunks(store.load_index(spark, path), small_chunks(spark, 4, 10), cfg)
    store.save_index(grown, path)
    assert sorted(map(tuple, hybrid.retrieve(store.load_index(spark, path), q, cfg).collect())) == want
    with pytest.raises(ValueError):
        store.save_index(hybrid.build_index(small_chunks(spark, 0, 1).limit(0), cfg), path)
    with pytest.raises(ValueError):
        store.append_chunks(grown, small_chunks(spark, 0, 1), RetrievalConfig(dim=16))
    with pytest.raises(ValueError):
        store.append_chunks(grown, small_chunks(spark, 0, 1).drop("tags"), cfg)


def test_agent(spark):
    cfg = RetrievalConfig(k=2)
    chunks = small_chunks(spark, 0, 6)
    notes = chunks.select(F.col("note_id").alias("id"), "title", F.col("text").alias("content"))
    q = spark.createDataFrame([(1, "open n2.md"), (2, "open nope.md"), (3, "topic4"), (4, "zzz!"), (5, "??")], "qid long, text string")
    got = {r.qid: r for r in ask(hybrid.build_index(chunks, cfg), notes, q, cfg).collect()}
    assert got[1].answer == "T2\n\ntext about topic2 and shared" and got[1].tool_calls[0].args == {"note_id": "n2.md"}
    assert "nope.md" in got[2].answer and "topic4" in got[3].answer and len(got[3].tool_calls) == 1
    assert [c.args["query"] for c in got[4].tool_calls] == ["zzz!", f"zzz {an.NOTE_MARKER}"] and len(got[5].tool_calls) == 1


def test_chat_client(monkeypatch):
    for base in ("http://h", "http://h/", "http://h/v1", "http://h/v1/chat/completions"):
        assert llm.ChatClient(base, "m", "k").url == "http://h/v1/chat/completions"
    body = json.loads(llm.ChatClient("http://h", "m", "k").request("s", "u").data)
    assert [m["content"] for m in body["messages"]] == ["s", "u"]
    assert llm.content_of({"choices": [{"message": {"content": "x"}}]}) == "x"
    with pytest.raises(ValueError):
        llm.content_of({"choices": []})
    monkeypatch.delenv("QUILL_LLM_API_KEY", raising=False)
    assert llm.default_client() is None
    monkeypatch.setenv("QUILL_LLM_API_KEY", "k")
    assert llm.default_client().api_key == "k"
    monkeypatch.setenv("QUILL_RRF_K", "30")
    monkeypatch.setenv("QUILL_DIVERSIFY", "0")
    cfg = RetrievalConfig.from_env()
    assert cfg.rrf_k == 30 and cfg.diversify is False and cfg.k == 5


def test_streams(spark, tmp_path):
    cfg = RetrievalConfig(k=1)
    path = str(tmp_path / "index")
    store.save_index(hybrid.build_index(small_chunks(spark, 0, 5), cfg), path)
    spark.createDataFrame([(1, "topic1"), (2, "topic7")], "qid long, text string").write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([("n7.md", "T7", ["t"], [], "all about topic7", None, None), ("n1.md", "T", [], [], "known", None, None)], NOTE).write.parquet(str(tmp_path / "n"))
    st.ingest_stream(spark.readStream.schema(NOTE).parquet(str(tmp_path / "n")), path, str(tmp_path / "c1"), cfg).awaitTermination()
    index = store.load_index(spark, path)
    assert index.chunks.count() == 6
    st.answer_stream(spark.readStream.schema("qid long, text string").parquet(str(tmp_path / "q")), index, str(tmp_path / "out"), str(tmp_path / "c2"), cfg).awaitTermination()
    assert {r.qid: r.note_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "n1.md", 2: "n7.md"}
    ev_schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.select(*[c.split()[0] for c in ev_schema.split(", ")]).write.parquet(str(tmp_path / "e"))
    rates = st.question_rates(spark.readStream.schema(ev_schema).parquet(str(tmp_path / "e")))
    s = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    s.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM rates").first().n == src.count()


def test_judge_stops_after_n_verdicts(spark, tmp_path):
    import json

    from quillmesh.operators import evaluation as ev

    rows = spark.createDataFrame([(i, f"q{i}", "c", "a") for i in range(9)], "qid long, text string, context string, answer_body string")
    log = str(tmp_path / "asked")

    def chat(system, prompt):
        asked = prompt.split("\n")[1]
        with open(log, "a") as f:
            f.write(asked + "\n")
        return "no verdict" if asked in ("q0", "q2") else json.dumps({"correctness": 4, "groundedness": 5, "uses_context": True, "hallucination": False, "short_reason": ""})

    got = {r.qid: r.judge is not None for r in ev.judge_first(rows, chat, 3).collect()}
    assert got == {i: i in (1, 3, 4) for i in range(9)} and sorted(open(log).read().split()) == ["q0", "q1", "q2", "q3", "q4"]
    assert not any(r.judge for r in ev.judge_first(rows, chat, 0).collect())
