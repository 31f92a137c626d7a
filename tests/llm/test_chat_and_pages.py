"""Records and tables with further fields; pages of any length and nesting; the reader beside a slow one."""

import json
import random
import re
import time

import pytest

from wardgraph.llm import chat, pages

PAIR = [("user", "q"), ("assistant", "a")]


def test_records_with_further_fields(spark):
    turns = [{"role": "user", "content": "q", "name": "x"}, {"content": "a", "role": "assistant"}]
    records = [
        {"messages": turns, "id": 7},
        {"messages": turns, "meta": {"a": [{"b": 1}], "messages": 2}},
        {"prompt": "q", "response": "a", "lang": None},
        {"prompt": "q", "completion": "a", "score": 1.5, "tags": ["x", "y"]},
        {"instruction": "q", "input": None, "output": "a", "id": "é"},
        {"messages": []}, {"id": 7}, [1, 2], "text", 3,
    ]
    df = spark.createDataFrame([(k, json.dumps(x), "extra", None) for k, x in enumerate(records)] + [(50, "{", "e", None), (51, None, "e", None)], "conv_id long, record string, turn string, unread string")
    rows = chat.record_turns(df).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], -1 if r["turn"] is None else r["turn"])):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert [got[k] for k in range(5)] == [PAIR] * 5
    why = {r["conv_id"]: r["unread"] for r in rows if r["turn"] is None}
    assert why == {5: "no known layout", 6: "no known layout", 7: "no JSON object", 8: "no JSON object", 9: "no JSON object", 50: "no JSON object", 51: "no JSON object"}
    assert {r["conv_id"] for r in chat.format_turns(chat.readable(chat.record_turns(df))).collect()} == set(range(5))
    assert chat.record_turns(df, keep_unknown=False).where("turn IS NULL").count() == 0


def test_tables_with_further_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q" * 300_000, "en", 1), (1, 1, "assistant", "a", "en", 2), (1, 1, "assistant", "a", "en", 2)], "conv_id long, turn long, role string, text string, lang string, formatted int")
    out = chat.format_turns(chat.table_turns(rows)).collect()
    assert len(out) == 1 and chat.read_turns(out[0]["formatted"]) == [("user", "q" * 300_000), ("assistant", "a"), ("assistant", "a")]
    nested = spark.createDataFrame([(1, [("user", "q", 1), ("assistant", "a", 2)], "x")], "conv_id long, messages array<struct<role:string,content:string,n:int>>, place string")
    assert [(r["role"], r["text"]) for r in chat.table_turns(nested).orderBy("turn").collect()] == PAIR
    with pytest.raises(ValueError):
        chat.table_turns(spark.createDataFrame([], "conv_id long, words string"))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, record string")
    assert chat.read_back(chat.format_turns(chat.table_turns(empty))).count() == chat.record_turns(empty).count() == 0


OLD = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)


def test_markup_is_that_of_one_slow_pattern():
    rng = random.Random(3)
    parts = ["<a ", "<div>", "</div>", "x", " ", '"', "'", ">", "<", "<!--", "-->", "<!d>", "<?x", "=", "/", "<p class='a>b'>", "é"]
    for _ in range(3000):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        markup, at, got = pages._Markup(html), 0, []
        while found := markup.next(at):
            got.append(found)
            at = found[1]
        want = [(m.start(), m.end(), m[1] or "", (m[2] or "").lower(), m[3] or "") for m in OLD.finditer(html)]
        assert got == want, html


def slow_blocks(html):
    """Blocks by a plain walk that keeps the whole tree."""
    root = ["", False, False, []]
    stack, at = [root], 0
    for m in OLD.finditer(html):
        stack[-1][3].append(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if tag and m[1]:
            if tag in [n[0] for n in stack]:
                while stack.pop()[0] != tag:
                    pass
            else:
                stack[-1][3].append(["", False, False, []])  # an end without a start ends a block only
        elif tag:
            inside = any(n[2] for n in stack)
            node = [tag, pages._left_out(tag, m[3], inside), tag in pages.CONTENT_NAMES, []]
            stack[-1][3].append(node)
            stack.append(node)
    stack[-1][3].append(html[at:])

    def walk(node, inside):
        out, run = [], []
        for x in [*node[3], None]:
            if isinstance(x, str):
                run.append(x)
                continue
            text = " ".join("".join(run).split())
            out += [(text, inside)] if text else []
            run = []
            if x is not None and not x[1]:
                out += walk(x, inside or x[2])
        return out

    def articles(node):
        return any(x[2] or articles(x) for x in node[3] if not isinstance(x, str) and not x[1])

    found = walk(root, False)
    return [t for t, inside in found if inside or not articles(root)]


def test_blocks_are_those_of_a_slow_walk():
    rng = random.Random(5)
    parts = ["<div>", "</div>", "<section class='nav'>", "</section>", "<article>", "</article>", "<main>", "</main>", "one", " two\n", "<nav>", "</nav>", "<header>", "</header>"]
    for _ in range(3000):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert pages.read(html)[0] == slow_blocks(html), html


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<div>x", '<a "', "<a '\"", "<a", "<!-- ", "<p>x</b>", "<div></p>", "<?", "&lt", '<a b="'])
def test_long_pages_take_time_by_their_length(piece):
    start = time.time()
    for tail in ("", ">", '"', " \">"):
        pages.read(piece * (300_000 // len(piece)) + tail)
    assert time.time() - start < 8


def test_page_tables(spark):
    kind = "page_id long, url string, html string, text string, _x map<string,int>, host string"
    assert pages.main_text(spark.createDataFrame([], kind)).count() == 0
    rows = [(k % 2, f"http://a/{k}", f"<div><p>Bar</p></div><div>{'word ' * 5000}{k}</div>", "old", {"a": k}, "h") for k in range(4)]
    out = pages.main_text(spark.createDataFrame(rows, kind)).collect()
    assert sorted(r["text"] for r in out) == sorted("word " * 5000 + str(k) for k in range(4))
    assert {r["host"] for r in out} == {"h"} and {r["_x"]["a"] for r in out} == set(range(4))


def test_templates_inside_articles(spark):
    """Containers that recur on a host go from its articles; paragraphs that its pages share, and what stands on few pages, stay."""
    bar = "<div><p>Follow us</p><ul><li>One</li><li>Two</li></ul></div>"
    quote, table = "<p>As the law says.</p>", "<thead><tr><td>Name</td></tr></thead>"

    def page(k):
        return f"<body><nav>Top</nav><article><h1>Title</h1><p>Story {k} is told here.</p>{quote}<table>{table}<tr><td>{k} of many</td></tr></table>{bar}</article></body>"

    rows = [(k, "http://a/x", page(k)) for k in range(6)] + [(9, "http://b/x", page(9))] + [(k, f"http://c/{k}", f"<main><div>{'All of it. ' * 9}</div><p>{k}</p></main>") for k in range(10, 16)]
    out = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    told = "Title Story {0} is told here. As the law says. Name {0} of many"
    assert [out[k] for k in range(6)] == [told.format(k) for k in range(6)]
    assert out[9] == told.format(9) + " Follow us One Two"  # one page of its host
    assert [out[k] for k in range(10, 16)] == [f"{'All of it. ' * 9}{k}" for k in range(10, 16)]  # more than half of the text
