"""Decontamination, repeated passages and page text against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagelake.llm import decontaminate, dom, html_text, passages
from . import cases


def smith_waterman(a, b):
    best, row = 0, [0] * (len(a) + 1)
    for w in b:
        new = [0]
        for j, x in enumerate(a):
            new.append(max(0, row[j] + (2 if x == w else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, max(new))
    return best / (2 * max(1, len(b)))


def test_alignment_equals_the_full_matrix():
    rng = random.Random(4)
    for _ in range(150):
        a = [rng.choice(b"abcdef".hex()) for _ in range(rng.randint(0, 30))]
        b = [rng.choice(b"abcdef".hex()) for _ in range(rng.randint(1, 20))]
        share, start, end = decontaminate.align(a, b)
        assert share == smith_waterman(a, b)
        if share:
            assert smith_waterman(a[start:end], b) == share


def test_decontamination_finds_copies_and_edits(spark):
    rng = random.Random(8)
    items = [(i, cases.prose(40, rng)) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (None, cases.prose(40, rng)), (53, None)]
    item = dict(items[:12])
    inside = lambda i, t: f"{cases.prose(80, rng)} {t} {cases.prose(70, rng)}"
    leaks = {
        100: (0, inside(0, item[0])), 101: (1, inside(1, item[1].upper().replace(" ", ",  "))), 102: (2, inside(2, cases.edited(item[2], 7))),
        103: (3, " ".join(item[3].split()[:26])), 104: (4, inside(4, item[4]) + " " + item[4]), 105: (0, item[0]),
    }
    clean = [(200 + i, cases.prose(200, rng), "en", "a") for i in range(60)]
    rows = cases.awkward_rows() + clean + [(d, t, "en", "a") for d, (_, t) in leaks.items()] + [(None, item[5], "en", "a")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("gram", "place", "item")})
    got = decontaminate.contaminated(cases.table(spark, rows), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d, (i, _) in leaks.items()}
    words = {d: decontaminate.plain_words((t or "").encode()) for d, t, *_ in rows}
    for r in got:
        want = decontaminate.plain_words(item[r.item_id].encode())
        assert r.score == smith_waterman(words[r.doc_id], want)
        assert smith_waterman(words[r.doc_id][r.word_from : r.word_to], want) == r.score
    assert decontaminate.contaminated(cases.empty(spark), table).collect() == []
    assert decontaminate.contaminated(cases.table(spark), table.limit(0)).collect() == []


def test_edited_copies_beside_exact_ones(spark):
    """What is found in one document does not depend on which copies others hold."""
    rng = random.Random(13)
    items = [(i, cases.prose(37, rng)) for i in range(9)]
    rows, want = [], set()
    for i, text in items:
        for n, t in enumerate((text, cases.edited(text, 4 + i % 3), text)):
            rows.append((10 * i + n, f"{cases.prose(60, rng)} {t} {cases.prose(60, rng)}", "en", "a"))
            want.add((10 * i + n, i))
    got = decontaminate.contaminated(cases.table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def plain_chain(h, p):
    """Best score by trying every predecessor."""
    order = sorted(range(len(h)), key=lambda i: (h[i], -p[i]))
    score = {}
    for n, j in enumerate(order):
        before = [score[i] + passages.K - passages.GAP * (h[j] - h[i] + p[j] - p[i] - 2 * passages.K) for i in order[:n] if h[i] < h[j] and p[i] < p[j]]
        score[j] = max([passages.K, *before])
    return max(score.values())


def test_fenwick_chain_is_the_best_one():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        h, p = np.sort(rng.choice(400, n, replace=False)), rng.integers(0, 400, n)
        found = passages.chains(h, p)
        best = plain_chain(h.tolist(), p.tolist())
        total = lambda c: passages.K * len(c) - passages.GAP * sum(c[i + 1][0] - c[i][0] + c[i + 1][1] - c[i][1] - 2 * passages.K for i in range(len(c) - 1))
        assert abs(max([passages.K, *map(total, found)]) - best) < 1e-9
        assert all(a[0] < b[0] and a[1] < b[1] for c in found for a, b in zip(c, c[1:]))


def test_chains_of_ascending_matches_are_the_best_ones():
    """Matches that ascend in both documents have a way of their own."""
    rng = np.random.default_rng(7)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        h, p = (np.sort(rng.choice(900, n, replace=False)).tolist() for _ in range(2))
        found = passages.chains(h, p)
        total = lambda c: passages.K * len(c) - passages.GAP * sum(c[i + 1][0] - c[i][0] + c[i + 1][1] - c[i][1] - 2 * passages.K for i in range(len(c) - 1))
        assert abs(max([passages.K, *map(total, found)]) - plain_chain(h, p)) < 1e-9
        used = [m for c in found for m in c]
        assert len(set(used)) == len(used) and set(used) <= set(zip(h, p))


def test_seeds_of_a_batch_are_those_of_each_text():
    rng = random.Random(21)
    texts = [None, b"", b"a b c"] + [" ".join(rng.choices("abc", k=rng.randint(0, 14))).encode() for _ in range(300)] + [cases.prose(n, rng).encode() for n in (4, 6, 7, 400)]
    got = [[] for _ in texts]
    for t, at, seed in zip(*(x.tolist() for x in passages.seeds_of(texts))):
        got[t].append((at, seed))
    for text, own in zip(texts, got):
        h = passages.word_hashes(passages.lower_words(text))
        keys = passages.window_hashes(h, passages.K).tolist() if len(h) >= passages.K else []
        windows = [keys[i : i + passages.WINDOW] for i in range(max(len(keys) - passages.WINDOW + 1, min(len(keys), 1)))]
        assert own == [(at, keys[at]) for at in sorted({i + w.index(min(w)) for i, w in enumerate(windows)})]


def test_postings_are_dealt_out_once(spark):
    """One exchange of all seeds serves the aggregate and the join, and only seeds of several documents leave it."""
    rng = random.Random(22)
    text = cases.prose(90, rng)
    rows = [(i, f"{cases.prose(60, rng)} {text} {cases.prose(40, rng)}", "en", "a") for i in (1, 2, 3)]
    found = passages.linked(passages.postings(cases.table(spark, rows)))
    seeds = found.groupBy("seed").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("least"), F.max("hub").alias("hub")).collect()
    assert seeds and all(r.n > 1 and r.hub == r.least for r in seeds)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(seed") - final.count("ReusedExchange") <= 1 and "ReusedExchange" in final, final


def test_passages(spark):
    rng = random.Random(9)
    long, short, fuzzy = cases.prose(90, rng), cases.prose(30, rng), cases.prose(200, rng)
    around = lambda t: f"{cases.prose(100, rng)} {t} {cases.prose(60, rng)}"
    rows = [(300 + i, around(long), "en", "a") for i in range(25)] + [(400, around(short), "en", "a"), (401, around(short), "en", "a")]
    rows += [(500, around(fuzzy), "en", "a"), (501, around(cases.edited(fuzzy, 30)), "en", "a"), (None, around(long), "en", "a")]
    alone = [(600 + i, cases.prose(300, rng), "en", "a") for i in range(40)]
    got = passages.repeated_passages(cases.table(spark, rows + alone + cases.awkward_rows())).collect()
    words = {d: (t or "").encode().lower().split() for d, t, *_ in rows + alone}
    pairs = {(r.doc_id, r.other_id) for r in got if r.doc_id and r.doc_id >= 300}
    assert pairs == {(i, 300) for i in range(301, 325)} | {(501, 500)}
    # The base case of the awkward rows: copies, and one with light edits.
    assert {(2, 1), (3, 1), (15, 1), (11, 10)} <= {(r.doc_id, r.other_id) for r in got}
    for r in got:
        if r.other_id == 300:
            own, other = words[r.doc_id][r.word_from : r.word_to], words[300][r.other_from : r.other_to]
            assert " ".join(w.decode() for w in own).find(long.lower()) >= 0 and r.word_to - r.word_from < 100
            assert r.identity >= 0.8 and r.n_equal <= len(own) and len(other) >= 50
    assert passages.repeated_passages(cases.empty(spark)).collect() == []


def test_chains_are_cut_where_documents_differ(spark):
    """Shared passages with long unlike text between them in both documents, or in one."""
    rng = random.Random(10)
    head, foot, new = cases.prose(60, rng), cases.prose(60, rng), lambda n: cases.prose(n, rng)
    rows = [(i, f"{new(40)} {head} {new(n)} {foot} {new(40)}", "en", "a") for i, n in ((700, 150), (701, 170))]
    first, last = new(300), new(300)
    rows += [(710, f"{first} {last}", "en", "a"), (711, f"{first} {new(400)} {last}", "en", "a"), (712, f"{first} {new(40)} {last}", "en", "a")]
    got = passages.repeated_passages(cases.table(spark, rows)).collect()
    found = sorted((r.doc_id, r.word_from, r.word_to, r.other_from) for r in got)
    near = lambda x, y: len(x) == len(y) and all(p[0] == q[0] and max(abs(a - b) for a, b in zip(p, q)) <= 12 for p, q in zip(x, y))
    want = [(701, 40, 100, 40), (701, 270, 330, 250), (711, 0, 300, 0), (711, 700, 1000, 300), (712, 0, 640, 0)]
    assert near(found, want), found
    assert all(r.identity >= 0.8 and r.word_to - r.word_from >= 50 for r in got)


def test_edited_passages_are_found(spark):
    """Copies of 60 words with an edit in every sixth word and more rarely, at every phase."""
    rng = random.Random(11)
    rows, want = [], set()
    for every in (6, 8, 10, 15):
        for phase in range(0, every, 2):
            text, i = cases.prose(60, rng), 800 + 2 * len(want)
            copy = " ".join("changed" if n % every == phase else w for n, w in enumerate(text.split(" ")))
            rows += [(i + k, f"{cases.prose(50, rng)} {t} {cases.prose(50, rng)}", "en", "a") for k, t in enumerate((text, copy))]
            want.add((i + 1, i))
    got = passages.repeated_passages(cases.table(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == want


def test_passages_whose_parts_occur_before(spark):
    """The seeds of a passage begin in several documents that lack the whole of it, or earlier in the same one."""
    rng = random.Random(12)
    one, two, new = cases.prose(35, rng), cases.prose(35, rng), lambda: cases.prose(50, rng)
    both = f"{one} {two}"
    rows = [(900, f"{new()} {one} {new()}", "en", "a"), (901, f"{new()} {two} {new()}", "en", "a")]
    rows += [(902 + i, f"{new()} {both} {new()}", "en", "a") for i in range(12)]
    parts = [cases.prose(30, rng) for _ in range(3)]
    rows += [(950, " ".join([new(), parts[2], new(), parts[1], new(), parts[0], new(), *parts, new()]), "en", "a"), (951, " ".join([new(), *parts, new()]), "en", "a")]
    got = passages.repeated_passages(cases.table(spark, rows)).collect()
    words = {d: t.encode().lower().split() for d, t, *_ in rows}
    assert {(r.doc_id, r.other_id) for r in got} == {(903 + i, 902) for i in range(11)} | {(951, 950)}
    for i in {r.doc_id for r in got}:
        own = [b" ".join(words[i][r.word_from : r.word_to]).decode() for r in got if r.doc_id == i]
        assert any((both if i < 950 else " ".join(parts)).lower() in o for o in own)


def test_edited_passages_whose_pieces_occur_before(spark):
    """Each piece of 12 words stands in an earlier document of its own, so no single one has the seeds of a passage."""
    rng = random.Random(13)
    rows, want, new = [], set(), lambda n: cases.prose(n, rng)
    for n in range(20):
        text, i = new(70), 2000 + 20 * n
        words = text.split(" ")
        pieces = [" ".join(words[at : at + 12]) for at in range(0, 70, 6)]
        rows += [(i + k, f"{new(40)} {t} {new(40)}", "en", "a") for k, t in enumerate([*pieces, text, cases.edited(text, 10)])]
        want.add((i + len(pieces) + 1, i + len(pieces)))
    got = passages.repeated_passages(cases.table(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == want


def test_asking_seeds_far_apart_make_no_pair(spark):
    """Documents that share asking seeds here and there, but never so many among MIN_WORDS words, are not matched at all."""
    asked = [(9, seed, 200 * seed, True, 3) for seed in range(40)] + [(9, 100 + k, 9000 + 9 * k, True, 3) for k in range(5)]
    others = [(1, seed, seed) for seed in range(40)] + [(2, 100 + k, k) for k in range(5)] + [(3, 100, 5), (3, 101, 9), (3, 0, 50)] + [(8, 102 + k, k) for k in range(3)]
    frames = [spark.createDataFrame(rows, kind) for rows, kind in ((asked, "doc_id long, seed long, pos int, asks boolean, least int"), (others, "hub long, seed long, hub_pos int"))]
    assert sorted(r.hub for r in passages.asked_pairs(*frames).collect()) == [2, 8]


def test_words_that_repeat_over_and_over(spark):
    """A pair of words, 300 times in a row: its runs stand in many places of both documents."""
    rng = random.Random(14)
    pair, new = " ".join(["is", "onhe."] * 300), lambda n: cases.prose(n, rng)
    rows = [(i, f"{new(30 + i % 7)} {pair} {new(50)}", "en", "a") for i in (3000, 3001, 3002)]
    got = passages.repeated_passages(cases.table(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(3001, 3000), (3002, 3000)}
    for i in (3001, 3002):
        inside = {w for r in got if r.doc_id == i for w in range(r.word_from, r.word_to)}
        assert inside >= set(range(30 + i % 7 + passages.K, 630 + i % 7 - passages.K))


def test_one_whole_run_whose_pieces_occur_before(spark):
    """A passage of just MIN_WORDS words, all of whose seeds begin in other documents."""
    rng = random.Random(15)
    new = lambda n: cases.prose(n, rng)
    text = new(passages.MIN_WORDS)
    words = text.split(" ")
    pieces = [" ".join(words[at : at + 20]) for at in range(0, 50, 10)]
    rows = [(3100 + k, f"{new(40)} {t} {new(40)}", "en", "a") for k, t in enumerate([*pieces, text, text])]
    got = passages.repeated_passages(cases.table(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(3106, 3105)}


def test_seeds_that_ask():
    """Every set of seeds that covers SURE words of MIN_WORDS has one that asks, whatever the levels."""
    rng = np.random.default_rng(16)
    for _ in range(60):
        pos = np.unique(rng.integers(0, 160, rng.integers(5, 80)))
        level = rng.integers(1, 6, len(pos))
        asks = passages.asking(pos, level)
        for start in range(0, 150):
            here = np.flatnonzero((pos >= start) & (pos + passages.K <= start + passages.MIN_WORDS))
            for least in range(1, 7):
                kept = [x for x in here if level[x] >= least]
                cover = {w for x in kept for w in range(pos[x], pos[x] + passages.K)}
                if least == 1:  # the set as a whole: enough of its seeds ask
                    fewest = -(-(passages.SURE - passages.most_covered(pos[~asks])) // passages.K)
                    assert len(cover) < passages.SURE or asks[here].sum() >= fewest
                assert len(cover) < passages.SURE or asks[[x for x in kept if level[x] == level[kept].min()]].all()


PAGES = [
    ("<html><body><nav><a>Menu</a></nav><article><h1>A title</h1><p>First &amp; last,\n   with <b>bold</b> words.<br>Next line.<p>Second "
     "one, never closed.<div class='ad'>Buy this now</div></article><footer>&copy; Us</footer><script>var x = '<p>no</p>'</script></body></html>",
     "A title\nFirst & last, with bold words. Next line.\nSecond one, never closed."),
    ("<div class=menu><a>One</a><a>Two</a></div><div class=content><h2>On rivers</h2><p>Rivers run to the sea, mostly downhill.</p><p>They are "
     "long, and wet.</p></div><div id=comments><p>I like rivers too, they are wet.</p></div><form><label>Name</label></form>",
     "On rivers\nRivers run to the sea, mostly downhill.\nThey are long, and wet."),
    (None, ""), ("", ""), ("<p></p> \n ", ""), ("<script>only('this')", ""), ("<!-- nothing", ""), ("<", None), ("<<p>>x & &#x41; &unknown;", None),
]


def test_page_text(spark):
    rows = [(i, f"http://x/{i}", h) for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0])] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "h")})
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for i, (_, want) in enumerate(PAGES):
        assert want is None or text[i] == want
    assert text[None] == PAGES[0][1] and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).collect() == []


def test_blocks_and_very_long_pages():
    blocks = dom.leaf_blocks("<ul class='Top-Nav x'><li>a<li>b <a href=x>c</a></ul><table><tr><td>d<td>e</table>" + "<p>f" * 3000)
    assert [b.text for b in blocks[:4]] == ["a", "b c", "d", "e"] and len(blocks) == 3004
    assert blocks[0].tags == ("ul", "li") and blocks[0].names == ("top", "nav", "x") and blocks[1].linked == 1


def test_elements_without_end_tags():
    texts = lambda html: [b.text for b in dom.leaf_blocks(html)]
    article = "<article><p>First words.</p><p>Last words.</p></article>"
    want = ["First words.", "Last words."]
    assert texts(f'<form><datalist><option value="a">x<option value="b">y</datalist></form>{article}') == want
    assert texts(f"<form><select><option>x<option>y</select> <select><option>z</form>{article}") == want
    assert texts(f"<select><option>x{article}<select><option>y</option></select>") == want
    for tag in ("svg", "object", "iframe", "noscript", "template"):
        assert texts(f"<div><{tag}>x</div>{article}<div><{tag}>y</{tag}></div>") == want
        assert texts(f"<div><{tag}><div>x</div></{tag}></div>{article}") == want
        assert texts(f"<{tag}>{article}") == want
    assert texts(f"{article}<script>x") == want and texts("<p>a <select><option>b</option></select> c") == ["a", "c"]


def test_held_out_accuracy_and_viterbi(spark, sf):
    """Trained without a fifth of the pages, the field labels that fifth; decoding is the best of all paths."""
    learnt = html_text.labelled_pages(spark.read.parquet(f"{sf}/pages.parquet"))
    held = learnt[::5]
    chain = html_text.fit(html_text.TEACHING_WEIGHT * html_text.teaching_pages() + [p for i, p in enumerate(learnt) if i % 5])
    wrong = sum(a != b for seen, labels in held for a, b in zip(chain.decode(seen), labels))
    assert wrong <= 0.01 * sum(len(labels) for _, labels in held)
    for seen, _ in html_text.teaching_pages()[:3]:
        seen = seen[:9]
        scores = chain.scores(seen)
        total = lambda path: sum(scores[i, x] for i, x in enumerate(path)) + sum(chain.steps[a, b] for a, b in zip(path, path[1:]))
        paths = [[n >> i & 1 for i in range(len(seen))] for n in range(1 << len(seen))]
        assert abs(total(chain.decode(seen)) - max(map(total, paths))) < 1e-9
