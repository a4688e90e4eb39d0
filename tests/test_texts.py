"""Values derived by hand for single texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import dom, porter, rank, texts
from threadloom.operators import graph, messages, review
from threadloom.sources import pages as page_source
from threadloom.sources import transcripts

STEMS = (
    "ponies poni ties tie flies flie queries queri query queri caresses caress agreed agre feed feed plastered plaster motoring motor sing sing "
    "conflated conflat troubled troubl sized size hopping hop falling fall filing file happy happi sky sky relational relat rational ration "
    "digitizer digit operator oper feudalism feudal formaliti formal sensibiliti sensibl triplicate triplic formative form electrical electr "
    "hopeful hope goodness good revival reviv allowance allow adoption adopt controlling control roll roll cease ceas generalizations gener "
    "apology apologi partitioning partit aed a aing a ies ie"
).split()


def _one(spark, column, *values, names=("x",)):
    types = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([values], types).select(column.alias("y")).first()["y"]


def test_stems():
    for word, want in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert porter.stem(word) == want, word


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a" * 119 + "éb", "a" * 119 + "�..."),
        ("a" * 120, "a" * 120),
        ("x```a```y", "xy"),
        ("x```a", "x```a"),
        ("", ""),
    ],
)
def test_summary(spark, text, want):
    assert _one(spark, texts.summary("x"), text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("```py \r\nx\n\n```", [("py", "x")]),
        ("```inline``` a\nb", []),
        ("```a``` z\ncode\n```", [("a``` z", "code")]),
        ("```\nx```", [("", "x")]),
    ],
)
def test_code_blocks(spark, text, want):
    assert [tuple(b) for b in _one(spark, texts.code_blocks("x"), text)] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[a](https://x.io) [b](https://x.io) https://x.io", ["https://x.io"] * 2),
        ("[a](/rel)", []),
        ('[a](https://x.io "t")', ['https://x.io "t"', "https://x.io"]),
        ("https:// http", ["https://"]),
    ],
)
def test_links(spark, text, want):
    assert _one(spark, texts.links("x"), text) == want


def test_bold(spark):
    assert _one(spark, texts.bold_terms("x"), "**a** **** **open") == ["a"]
    assert _one(spark, texts.bold_terms("x"), "**" + "b" * 80 + "**") == []


def _kept(text):
    words = [w for w in __import__("re").findall("[a-z]+", text.lower()) if len(w) > 2 and w not in texts.STOP_WORDS]
    pairs = [(w, porter.stem(w)) for w in words if len(porter.stem(w)) > 1]
    return [w for w, _ in pairs], [s for _, s in pairs]


def test_keywords():
    words, stems = _kept("Spark joins partition data. Spark partition keys shuffle data before joins.")
    got = {s: round(x, 6) for s, x in rank.scores(stems).items()}
    assert got == {"partit": 1.356478, "data": 1.208572, "spark": 1.040176, "join": 0.894796, "shuffl": 0.75194, "kei": 0.748038}
    assert [p for p, _ in rank.keywords_of(words, stems)] == ["Spark Joins", "Partition Data", "Spark Partition", "Shuffle Data", "Joins"]
    words, stems = _kept("Shuffle shuffles shuffled shuffling data")
    assert [p for p, _ in rank.keywords_of(words, stems)] == ["Shuffle", "Shuffle Data"]
    assert rank.keywords_of(*_kept("the and of to")) == []
    assert rank.scores(["spark"]) == {"spark": pytest.approx(0.15)}


def _walked(stems, best):
    """Phrases by a plain walk."""
    out, i = [], 0
    while i < len(stems):
        if stems[i] in best and i + 1 < len(stems) and stems[i + 1] in best and stems[i + 1] != stems[i]:
            out.append(f"{stems[i]}_{stems[i + 1]}")
            i += 2
        else:
            out += [stems[i]] if stems[i] in best else []
            i += 1
    return list(dict.fromkeys(out))


def _one_by_one(stems, window=3):
    """Scores of one message, vertex by vertex."""
    weight = {}
    for i, a in enumerate(stems):
        for b in stems[i + 1 : i + window]:
            if a != b:
                for x, y in ((a, b), (b, a)):
                    weight.setdefault(x, {}).setdefault(y, 0)
                    weight[x][y] += 1
    score = dict.fromkeys(stems, 1.0)
    for _ in range(rank.ROUNDS):
        new = {v: 0.15 + 0.85 * sum(score[u] * weight[u][v] / sum(weight[u].values()) for u in weight if v in weight[u]) for v in score}
        moved, score = max((abs(new[v] - score[v]) for v in score), default=0), new
        if moved < rank.SETTLED:
            break
    return score


_STEMS = st.lists(st.sampled_from(["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op"]), max_size=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), _STEMS), max_size=8), st.integers(2, 5))
def test_batches_rank_like_single_messages(rows, window):
    sizes = np.array([len(r or []) for r in rows], np.int64)
    flat = pa.array([s for r in rows for s in r or []], pa.string())
    g = rank.ranked(flat, sizes, window)
    for i, r in enumerate(rows):
        here = g.vertex_row == i
        got = dict(zip(np.array(g.stems.to_pylist(), object)[here], g.score[here], strict=True))
        assert got == pytest.approx(_one_by_one(r or [], window), abs=1e-12)
    at, shown, keys = rank.phrases(flat, flat, sizes, window=window)
    for i, r in enumerate(rows):
        one = rank.keywords_of(r or [], r or [], window=window)
        assert [(p, k) for a, p, k in zip(at.tolist(), shown.to_pylist(), keys.to_pylist(), strict=True) if a == i] == one


def test_joins_rank_like_batches(spark):
    rows = [(1, "Spark joins partition data. Spark partition keys shuffle data before joins."), (2, "alone"), (3, None), (4, ""), (5, " ".join(f"w{chr(97 + i % 7)}{chr(97 + i % 11)}x" for i in range(400)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {(r.doc_id, r.stem): r.score for r in messages.textrank_scores(df, ("doc_id",), "text").collect()}
    two = {(r.doc_id, r.stem): r.score for r in messages.textrank_by_joins(df, ("doc_id",), "text").collect()}
    assert two == pytest.approx(one, abs=1e-9) and {k for k, _ in two} == {1, 2, 5}


_MIXED = [(1, "spark joins partition data spark partition keys"), (2, "alone"), (3, None), (4, "shuffle keys before joins"), (4, "keys shuffle data"), (None, "spark keys"), (None, "keys joins")]


def test_large_and_shared_texts_rank_by_joins(spark):
    one = spark.createDataFrame([r for r in _MIXED if r[0] in (1, 2, 3)], "doc_id long, text string")
    want = {(r.doc_id, r.stem): r.score for r in messages.textrank_scores(one, ("doc_id",), "text").collect()}
    both = spark.createDataFrame([r for r in _MIXED if r[0]], "doc_id long, text string")
    got = {(r.doc_id, r.stem): r.score for r in messages.textrank_by_joins(both, ("doc_id",), "text", large=10).collect()}
    assert {k: v for k, v in got.items() if k[0] != 4} == pytest.approx(want, abs=1e-9) and {k for k, _ in got} == {1, 2, 4}


def test_small_texts_rank_without_rounds(spark):
    df = spark.createDataFrame([r for r in _MIXED if r[0] in (1, 2, 3)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("rank", "rank")
    messages.textrank_by_joins(df, ("doc_id",), "text").collect()
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rank")) < 10


def test_cooccurrence_is_counted_in_rows(spark):
    rows = spark.createDataFrame(_MIXED, "doc_id long, text string")
    want = {}
    for doc, text in _MIXED:
        stems = [porter.stem(w) for w in (text or "").split() if w != "before"]
        for i, d in ((i, d) for d in (1, 2) for i in range(len(stems) - d)):
            for pair in ((stems[i], stems[i + d]), (stems[i + d], stems[i])):
                if pair[0] != pair[1]:
                    want[doc, *pair] = want.get((doc, *pair), 0) + 1
    got = messages.cooccurrence(rows, ("doc_id",), "text").collect()
    assert {(r.doc_id, r.src, r.dst): r.weight for r in got} == want and len(got) == len(want)
    plan = messages.cooccurrence(rows.where("doc_id < 4"), ("doc_id",), "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stems_and_ranks_share_a_worker(spark):
    df = spark.createDataFrame([(1, 0, "user", "spark joins")], "conv_id long, turn long, role string, content string")
    for made in (graph.message_parts(df), messages.keywords(df), messages.textrank_scores(df)):
        assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert rank.WORDS <= 1 << 15 and porter.stem.cache_info().maxsize <= 1 << 16


def test_pages_are_read_in_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([None] * 1000, pa.string())], ["a", "b"])
    parts = list(page_source._parts(batch))
    assert max(map(len, parts)) <= page_source.PART and [r for p in parts for r in p] == [(i, None) for i in range(1000)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "cd", "ef", "gh", "ij", "kl", "mn"]), max_size=30))
def test_phrases_follow_a_walk(stems):
    ranked = rank.scores(stems) if stems else {}
    best = set(sorted(ranked, key=lambda s: (-round(ranked[s], 9), s))[:5])
    assert [k for _, k in rank.keywords_of(stems, stems)] == _walked(stems, best)[:5]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("How do Spark joins partition data?", "Spark How"),
        ('df.join(other, "key")', "Other Join"),
        ("def load_table(path): return spark.read.parquet(path)", "Load_table Path"),
        ("a b c", "a b"),
        ("über API", "Api"),
    ],
)
def test_text_label(spark, text, want):
    assert _one(spark, review.text_label(F.col("x")), text) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://spark.apache.org/docs", "Apache"),
        ("https://www.github.com/Org1/repo", "Org1"),
        ("https://github.com/", "Github"),
        ("http://localhost:8080/x", "Localhost"),
        ("https://example.co.uk/a", "Co"),
        ("/rel/path", "Path"),
        ("https://", "Https"),
        ('https://spark.apache.org/docs "t"', "Apache"),
    ],
)
def test_url_label(spark, url, want):
    assert _one(spark, review.url_label(F.col("x")), url) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>Use <code>df</code> and <strong>join</strong> <em>now</em><br>ok</p>", "Use `df` and **join** *now*\nok"),
        ('<pre><code class="language-python">x = 1</code></pre>', "```python\nx = 1\n```"),
        ("<ul><li>a</li><li>b <b>c</b></li></ul>", "- a\n- b **c**"),
        ('<ol start="5"><li>x</li><li>y</li></ol>', "1. x\n2. y"),
        ("<h2> T <i>u</i></h2>", "## T u"),
        ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n\nr"),
        ('<a href="/x">go</a>', "[go](https://h.example/x)"),
        ("<div>keep<button>no</button><span hidden>no</span></div>", "keep"),
        ("", ""),
    ],
)
def test_markdown(html, want):
    assert dom.html_to_markdown(html, "https://h.example/p") == want


def _told(url, html):
    return [m[:2] for m in dom.page_messages(url, html)]


def test_page_profiles():
    two = '<main><div data-message-author-role="user"><p>Hello there friend</p></div><div data-message-author-role="assistant"><p>General reply text</p></div></main>'
    assert _told("https://chatgpt.com/c/1", two) == [("user", "Hello there friend"), ("assistant", "General reply text")]
    gemini = '<user-query>Hi</user-query><model-response>Yo</model-response><div class="user-query-x">Again</div>'
    assert _told("https://gemini.google.com/app", gemini) == [("user", "Hi"), ("assistant", "Yo"), ("assistant", "Again")]
    rows = "<div>first block of some length</div><div{}>second block of some length</div><div>third block of some length</div>"
    page = "<body><nav>" + "x " * 200 + "</nav><section>" + rows + "</section></body>"
    assert [r for r, _ in _told("https://a.example/", page.format(""))] == ["user", "assistant", "user"]
    assert [r for r, _ in _told("https://a.example/", page.format(' class="human-turn"'))] == ["user", "user", "user"]
    articles = "<body><article>one article here</article><p>between</p><article>two article here</article></body>"
    assert [c for _, c in _told("https://a.example/", articles)] == ["one article here", "two article here"]
    for zone in ('<div class="chat-sidebar">', '<div role="navigation">', "<footer>"):
        tag = zone[1:].split()[0].rstrip(">")
        inner = f"{zone}<article>hidden away in here</article></{tag}>"
        assert _told("https://a.example/", f"<body>{inner}<article>one article here</article><article>two article here</article></body>")[0][1] == "one article here"
    assert dom.page_messages(None, None) == []
    assert dom.page_messages("http://[bad", "<div>") == []


def test_transcripts(spark):
    raw = "Intro line\nYou: hi\nthere\nassistant : yo\nClaude: \nAI: end"
    rows = [(1, raw), (2, "You:"), (3, "  \n "), (4, None), (5, "")]
    got = transcripts.parse_transcript(spark.createDataFrame(rows, "conv_id long, raw string")).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.role, r.content) for r in got] == [
        (1, "user", "Intro line"), (1, "user", "hi\nthere"), (1, "assistant", "yo"), (1, "assistant", "end"), (2, "user", "You:"),
    ]


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://chat.openai.com/x", "chatgpt"), ("https://chatgpt.com/", "chatgpt"), ("https://claude.ai/new", "claude"), ("https://gemini.google.com/app", "gemini"), ("https://m.example.net/", "generic"), ("no address", "generic")],
)
def test_platform(spark, url, want):
    assert _one(spark, transcripts.detect_platform("x"), url) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a <a href='http://[x'>b</a></p>", "a [b](http://[x)"),
        ("<div>" * 5000 + "a", "a"),
        ("<blockquote>" * 2000 + "a", "> " * 2000 + "a"),
        ("<table>" + "<tr><td><p>a" * 3000, "\n\n".join("a" * 3000)),
        ("<table><tr><td>a<table><tr><td>b<td>c</table>d<th>e<tr><td>f</table>", "abcdef"),
        ("<![foo[x]]>a", "a"),
        ("&#" + "9" * 5000 + ";a", "\ufffda"),
    ],
)
def test_odd_markup(html, want):
    assert dom.html_to_markdown(html, "https://h.example/p") == want


def test_implied_tags():
    def tags(e):
        return [(c.tag, tags(c)) if c.children else c.tag for c in e.children]

    cells = dom.parse("<table><tbody><tr><td>a<th>b<tr><td><table><tr><td>c<td>d</table><td>e<tbody><tr><td>f</table>")
    row = ("tr", ["td", "th"]), ("tr", [("td", [("table", [("tr", ["td", "td"])])]), "td"])
    assert tags(cells) == [("table", [("tbody", [*row]), ("tbody", [("tr", ["td"])])])]
    assert tags(dom.parse("<dl><dt>a<dd>b<dl><dt>c</dl><dd>d</dl>")) == [("dl", ["dt", ("dd", [("dl", ["dt"])]), "dd"])]
    assert tags(dom.parse("<select><option>a<option>b<optgroup><option>c<optgroup><option>d</select>")) == [
        ("select", ["option", "option", ("optgroup", ["option"]), ("optgroup", ["option"])])
    ]


def test_no_page_is_lost(spark):
    turns = "<article>A question that is long enough</article><article>An answer {}that is long enough</article>"
    odd = ["", "<a href='http://[x'>link</a> ", "<i>" * 3000, "<table>" + "<tr><td>" * 3000 + "</table>", "<![foo[x]]>"]
    pages = spark.createDataFrame([(i, "https://h.example/p", turns.format(o)) for i, o in enumerate(odd)], "page_id long, url string, html string")
    got = {}
    for r in page_source.page_messages(pages).orderBy("page_id", "turn").collect():
        got.setdefault(r.page_id, []).append(r.role)
    assert got == dict.fromkeys(range(len(odd)), ["user", "assistant"])
    made = pages.select(page_source.html_to_markdown("html", "url").alias("m")).collect()
    assert all("A question" in r.m and "that is long enough" in r.m for r in made)
    nodes = graph.graph_nodes(page_source.page_messages(pages).withColumnRenamed("page_id", "conv_id"))
    assert nodes.where("type = 'task'").groupBy("conv_id").count().where("count = 2").count() == len(odd)
