import collections
import random
import re
from html import unescape

import numpy as np
import pyarrow as pa
import pytest

from pulsemart.llm import boilerplate as b

PAGES = "page_id long, url string, html string, text string, key string"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi pi rho sigma tau phi chi psi omega".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute(rows):
    """The text of every row with repeated windows counted over all pages of a host in one dictionary."""
    pages, seen = {}, collections.defaultdict(set)
    for i, (_, url, page) in enumerate(rows):
        key, host = b.page_key(url, page)
        blocks = b.blocks_of(page)
        tokens, _ = b.stream(blocks, host, key)
        pages[i] = (blocks, host, key, tokens.tolist())
        for at in range(len(tokens) - b.RUN + 1):
            seen[tuple(tokens[at:at + b.RUN].tolist())].add(key)
    hosts, having = collections.defaultdict(set), collections.defaultdict(set)
    for blocks, host, key, _ in pages.values():
        hosts[host].add(key)
        for zone, _, words in blocks:
            if zone != b.SIDE:
                having[host, words].add(key)
    out = []
    for i, (page_id, url, _) in enumerate(rows):
        blocks, host, key, tokens = pages[i]
        spans = [(at, at + b.RUN) for at in range(len(tokens) - b.RUN + 1) if len(seen[tuple(tokens[at:at + b.RUN])]) > 1]
        wide = {b.block_name(host, w) for (h, w), keys in having.items()
                if h == host and len(keys) >= b.WIDE_PAGES and len(keys) >= b.WIDE_SHARE * len(hosts[host])}
        out.append((page_id, url, *b.main_text(blocks, host, key, spans, wide)))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    return sorted(((r.page_id, r.url, r.text, r.n_repeated) for r in rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(4)


@pytest.mark.parametrize("page, blocks", [
    ("<p>a  b<br>c<p>d", ["a b c", "d"]),
    ("<article><h1>T</h1><p><b>one<br><p>two &amp; &lt;x&gt; &eacute;&nbsp;z</article><footer>f</footer>", ["T", "one", "two & <x> é z"]),
    ("<main><nav>m</nav><p>in</p><section class='comments'><p>c</p></section></main><p>out", ["in"]),
    ("<main><article>x</article><div>related</div></main>", ["x"]),
    ("<script>if(a<b){'<p>no</p>'}</script><style>p{}</style><p>yes<!-- <p>no</p> --> too", ["yes too"]),
    ("<div class='cookie-banner'>c</div><div class=with-sidebar>body</div><form><label>l</label></form>", ["body"]),
    ("<p title='a > b'>t</p> 3 < 4 <p hidden>h</p>", ["t", "3 < 4"]),
    ("<header>h</header><article><header><h2>own</h2></header>w<b>or</b>d <span class=ad>ad</span></article>", ["own", "word"]),
    ("<head><title>t<body><p>x", []),
    ("<head><meta charset=x><body><ul><li>1<li>2</ul><!-- open", ["1", "2"]),
    (None, []), ("", []), ("plain text", ["plain text"]), ("<", ["<"]), ("<p", []),
])
def test_blocks_and_elements(page, blocks):
    text, _ = b.main_text(b.blocks_of(page), 0, b"k", [], set())
    assert text == "\n\n".join(blocks)


def test_suffix_array_is_sorted_and_names_windows():
    rng = np.random.default_rng(1)
    for run in (1, 2, 3, 5, 8):
        sizes = rng.integers(run, 14, 40)
        tokens = rng.integers(0, 3, sizes.sum()).astype(np.uint32)
        ends = np.repeat(np.cumsum(sizes), sizes)
        order, name = b.suffix_ranks(tokens, ends, run)
        suffixes = [tuple(tokens[i:ends[i]].tolist()) for i in range(len(tokens))]
        assert [suffixes[i] for i in order] == sorted(suffixes)
        windows = {}
        for i, s in enumerate(suffixes):
            assert (name[i] < 0) == (len(s) < run)
            if len(s) >= run:
                assert windows.setdefault(s[:run], name[i]) == name[i]
        assert len(set(windows.values())) == len(windows)


def open_pages():
    """Pages without an article: templates around own text, shared passages, copies, several hosts."""
    rng, rows = random.Random(8), []
    shared = [sentence(rng, 20) for _ in range(3)]
    for i in range(90):
        host = ["a.example", "B.example", "c.example"][i % 3 if i % 9 else 0]
        top, low = f"<div>{host} home about contact products {' '.join(WORDS[:8])}</div>", f"<div><i>terms of {host}</i> {' '.join(WORDS[8:18])}</div>"
        body = "".join(f"<p>{sentence(rng, rng.randint(1, 40))}</p>" for _ in range(rng.randint(0, 4)))
        if i % 4 == 0:
            body += f"<p>{sentence(rng, 5)} {rng.choice(shared)} {sentence(rng, 5)}</p>"
        rows.append((i, f"https://{host}/{i}", f"<html><body>{top}{body}{low}</body>"))
    rows += [(200 + i, rows[7][1], rows[7][2]) for i in range(5)]
    rows += [(None, None, None), (300, "no host", ""), (301, "", "<p>" + sentence(rng, 30_000)), (301, "", "<p>same " + "same " * 3000)]
    return rows


def test_equals_brute_force_on_open_pages(spark, monkeypatch):
    rows = open_pages()
    expected = brute(rows)
    assert found(b.extract(frame(spark, rows))) == expected
    assert any("home about" in (r[2] or "") for r in rows) and not any("home about" in r[2] for r in expected)
    assert sum(r[3] for r in expected) > 1000
    monkeypatch.setattr(b, "HOT_STRINGS", 3)
    monkeypatch.setattr(b, "SHARD_TOKENS", 100)
    assert found(b.extract(frame(spark, rows))) == expected


def test_share_bars_go_and_shared_passages_stay(spark):
    rng = random.Random(2)
    quote = sentence(rng, 30)
    own = [sentence(rng, 25) for _ in range(20)]
    rows = [(i, "http://h/", f"<article><p>{t}</p><p>{quote if i % 3 == 0 else t[::-1]}</p><p>Share this page</p></article>") for i, t in enumerate(own)]
    out = {r[0]: r[2] for r in found(b.extract(frame(spark, rows)))}
    for i, t in enumerate(own):
        assert out[i] == f"{t}\n\n{quote if i % 3 == 0 else t[::-1]}"


def test_the_token_stream_is_the_whole_page():
    page = "<nav>home about</nav><article><h1>one two</h1><p>three four five six seven eight nine ten eleven</article><footer>end</footer>"
    blocks = b.blocks_of(page)
    other = b.blocks_of(page.replace("seven", "other"))
    one, two = b.stream(blocks, 5, b"k")[0], b.stream(other, 5, b"k")[0]
    assert len(one) == len(two) and (one != two).sum() == 1
    outside, inside, edge = b.layout(blocks)
    assert [number for number, _ in outside] == [0, 3] and [number for number, _, _ in inside] == [1, 2]
    assert len(one) > edge + 11


def test_repeats_inside_articles_are_found_as_runs(spark, monkeypatch):
    rng = random.Random(3)
    one, two, quote = sentence(rng, 12), sentence(rng, 14), sentence(rng, 30)
    rows, expected = [], {}
    for i in range(24):
        own = [sentence(rng, 40), sentence(rng, 3), quote if i % 2 else sentence(rng, 30)]
        notice = f"{one} {two}" if i % 2 else f"{two} {one}"  # neither order is in nearly all pages, both runs are
        parts = [own[0], notice, own[1], own[2], f"{one} {own[1]}"]
        rows.append((i, "http://h/", "<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article><footer>f</footer>"))
        expected[i] = "\n\n".join([own[0], own[1], own[2], f"{one} {own[1]}"])
    assert {r[0]: r[2] for r in found(b.extract(frame(spark, rows)))} == expected
    monkeypatch.setattr(b, "HOT_STRINGS", 1)
    monkeypatch.setattr(b, "SHARD_TOKENS", 50)
    assert {r[0]: r[2] for r in found(b.extract(frame(spark, rows)))} == expected


def test_copies_of_a_page_do_not_make_its_lines_boilerplate(spark):
    rng = random.Random(4)
    line = sentence(rng, 20)
    bodies = [[sentence(rng, 30), line] if i < 5 else [sentence(rng, 30), sentence(rng, 20)] for i in range(15)]
    pages = ["<article>" + "".join(f"<p>{p}</p>" for p in body) + "</article>" for body in bodies]
    rows = [(i, "http://h/", page) for i, page in enumerate(pages)]
    rows += [(100 + i, "http://h/", pages[i % 5]) for i in range(60)]
    out = {r[0]: r[2] for r in found(b.extract(spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(16)))}
    for i in range(15):
        assert out[i] == "\n\n".join(bodies[i])
    for i in range(60):
        assert out[100 + i] == "\n\n".join(bodies[i % 5])


def test_counts_of_cells_are_never_too_low():
    rng = random.Random(5)
    pages = [f"<article><p>{sentence(rng, 30)}</p><p>{'fixed line ' * 6}</p></article>" for _ in range(40)]
    truth = collections.Counter()
    for page in pages:
        key, host = b.page_key("http://h/", page)
        truth.update(set(b.cells_of(*b.stream(b.blocks_of(page), host, key)).tolist()))
    rows, out = [b._streaming({"url": ["http://h/"] * 10, "html": pages[i:i + 10]}, 3) for i in range(0, 40, 10)], []
    for own in range(3):
        columns = {n: [v for part in rows for v, shard in zip(part[n], part["shard"]) if shard == own] for n in b._STREAMS.names}
        out += b._counting(pa.table(columns, schema=b._STREAMS)).to_pylist()
    assert {r["cell"]: r["n"] for r in out} == {c: n for c, n in truth.items() if n >= b.WIDE_PAGES} and max(truth.values()) == 40


def test_given_pages(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    out = {r.page_id: r.text for r in b.op12_main_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(out) == len(rows)
    for page_id, _, page in rows:
        inside = re.search("<article>(.*)</article>", page, re.S).group(1)
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert out[page_id] == "\n\n".join(x for x in blocks if x)
    small = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert found(b.op12_main_text(spark, sf_dir)) == brute(small)


def test_empty(spark):
    assert b.extract(frame(spark, [])).count() == 0
