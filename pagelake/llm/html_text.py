"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is the chain of its leaf blocks. Each block has features from its ancestors
(tag names, words of class, id and role) and from its text (length, share of links,
marks, place in the page); two labels, main text or not, with a weight for each
pair of neighbouring labels. Weights are fitted by the likelihood of labelled
pages, and a page is decoded by Viterbi.

Labelled pages are of two kinds. TEACHING_PAGES are small pages whose blocks are
labelled by hand; they teach menus, notices, adverts, forms and reader comments
that the crawl may mark up in many ways. And at most SAMPLE_PAGES pages of the
table, those with the least hash of their address, label themselves where they
carry an article or main element: what lies inside, outside their own navigation,
is text. Each is learnt twice, the second time with that element renamed to div,
so that the model does not hang on it alone. Only features, as hashed numbers,
reach the driver: at most SAMPLE_PAGES lists.

Defined results: null and empty html have an empty text; a page without text
blocks too. Null ids and urls are kept. Repeated rows are decoded alike. When no
page of the table labels itself, the hand-labelled pages are all there is.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .dom import Block, leaf_blocks
from .words import map_batches

SAMPLE_PAGES, TEACHING_WEIGHT, DIMENSIONS, ROUNDS, RIDGE = 300, 8, 1 << 13, 120, 0.02

_REGION = frozenset({"article", "main"})
_APART = frozenset({"nav", "aside", "footer", "form"})
# Class and id words of what is never the article's own text.
_APART_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb comment comments cookie newsletter notice popup promo related share sidebar social "
    "sponsored subscribe widget".split()
)

# Hand-labelled teaching pages. "+" before a block's text marks main text.
TEACHING_PAGES = [
    """<body><header><h1>-Daily Paper</h1><p>-All news, all day</p></header><nav><ul><li><a>-Home</a></li><li><a>-Sport</a></li>
    </ul></nav><main><h1>+A bridge is opened</h1><p>+The bridge over the river was opened on Monday, after four years of work.</p>
    <p>+It carries two tracks and a path for walkers.</p></main><aside class="sidebar related"><h3>-Most read</h3><ul><li><a>-Ten
    quick dinners</a></li></ul></aside><footer><p>-© Daily Paper. All rights reserved.</p></footer></body>""",
    """<body><div id="cookie-notice"><p>-We use cookies to improve our site. Please accept them.</p></div><div class="menu"><a>-News</a>
    <a>-Shop</a></div><div class="content post"><h2>+On growing beans</h2><p>+Beans like warm soil, so wait until the nights are mild.</p>
    <p>+Water them well.</p><blockquote>+My aunt never weeds them, and hers are taller.</blockquote><ul><li>+a spade</li><li>+some
    string</li></ul></div><div class="comments" id="comments"><h3>-3 comments</h3><div class="comment"><p>-I tried this and it works
    very well, thank you for the advice.</p></div><div class="comment reply"><p>-Mine were eaten by snails, all of them.</p></div></div>
    <form><label>-Your name</label><p>-Leave a reply</p></form><div class="footer">-Contact us</div></body>""",
    """<body><div class="ad banner advert">-Buy two pairs of shoes and get a third for free.</div><article><header><h1>+The winter
    market</h1></header><p>+Stalls stood in rows along the square.</p><div class="ad">-Holidays from 99 a week, book now.</div><p>+People
    came from the villages around, some of them on foot.</p><section class="comments"><p>-Lovely piece, I was there too and saw
    it.</p></section></article><div class="newsletter subscribe"><p>-Sign up for our letter, every week in your inbox.</p></div>
    <div class="share social"><a>-Share</a></div></body>""",
    """<body><table class="nav"><tr><td><a>-Index</a></td><td><a>-Next</a></td></tr></table><div class="breadcrumb"><a>-Start</a></div>
    <div class="entry text body"><h1>+Old maps</h1><p>+Old maps show the coast as sailors knew it: bays, depths, and little else.</p>
    <table><tr><th>+Year</th><th>+Sheet</th></tr><tr><td>+1702</td><td>+four</td></tr></table><p>+The rest was left white.</p></div>
    <div class="sidebar widget"><p>-About the author: she lives by the sea and writes about it.</p></div><div class="copyright">-2001 to
    2009, printed with permission.</div></body>""",
    """<body><div class="notice alert popup"><p>-This site will be closed for maintenance on Sunday.</p></div><div role="navigation"><ul>
    <li><a>-One</a></li><li><a>-Two</a></li></ul></div><div><h1>+A short walk</h1><p>+We set out early and came back before it rained.</p>
    <p>+Nothing happened.</p><p>+It was a good day, all the same, and we shall go again in spring.</p></div><div id="disqus_thread"
    class="discussion"><p>-First! I go there every year with my dog.</p></div><div class="promo sponsored"><p>-Paid content: see how much
    you can save.</p></div><div role="contentinfo"><p>-Imprint, privacy</p></div></body>""",
]


def _hash(name: str) -> int:
    return crc32(name.encode()) % DIMENSIONS


def features(blocks: list[Block], skip: frozenset[str] = frozenset()) -> list[np.ndarray]:
    """Feature numbers of each block; ``skip`` names tags to be seen as div."""
    out = []
    for i, b in enumerate(blocks):
        tags = ["div" if t in skip else t for t in b.tags]
        words = b.text.count(" ") + 1
        own = {f"in {t}" for t in tags} | {f"named {w}" for w in b.names}
        own |= {
            "any", f"own {tags[-1] if tags else ''}", f"words {min(words, 64).bit_length()}",
            f"links {round(4 * min(1.0, b.linked / len(b.text)))}", f"first {i == 0}", f"last {i == len(blocks) - 1}",
            f"stop {b.text[-1] in '.!?…'}", f"commas {min(b.text.count(','), 3)}", f"rights {bool(re.search('©|copyright|rights reserved', b.text, re.I))}",
        }
        out.append(np.array(sorted({_hash(x) for x in own}), np.int32))
    return out


def teaching_pages() -> list[tuple[list[np.ndarray], list[int]]]:
    found = []
    for html in TEACHING_PAGES:
        blocks = leaf_blocks(html)
        labels = [int(b.text[0] == "+") for b in blocks]
        for b in blocks:
            b.text = b.text[1:]
        found += [(features(blocks), labels), (features(blocks, _REGION), labels)]
    return found


def own_label(block: Block) -> int:
    """1 inside article or main, unless it is in a part that its tag or name sets apart; the page's own markup."""
    at = max((i for i, t in enumerate(block.tags) if t in _REGION), default=-1)
    return int(at >= 0 and not _APART.intersection(block.tags[at:]) and not _APART_NAMES.intersection(block.names))


def _learnt(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = {"seen": [], "ends": [], "labels": []}
    for html in batch.column("html").to_pylist():
        blocks = leaf_blocks(html)
        labels = [own_label(b) for b in blocks]
        if not any(labels):
            continue
        for skip in (frozenset(), _REGION):
            seen = features(blocks, skip)
            rows["seen"].append(np.concatenate(seen).tolist())
            rows["ends"].append(np.cumsum([len(s) for s in seen]).tolist())
            rows["labels"].append(labels)
    return pa.RecordBatch.from_pydict(rows, pa.schema([(k, pa.list_(pa.int32())) for k in rows]))


def labelled_pages(pages: DataFrame, sample: int = SAMPLE_PAGES) -> list[tuple[list[np.ndarray], list[int]]]:
    """The bounded sample of self-labelled pages, as features and labels."""
    marked = pages.where("html RLIKE '(?i)<(article|main)[ >]'").select(F.xxhash64("url", "page_id").alias("h"), "page_id", "html")
    least = marked.select("h", "page_id").orderBy("h", "page_id").limit(sample)
    chosen = marked.join(F.broadcast(least.dropDuplicates()), ["h", "page_id"], "left_semi").select("html")
    rows = map_batches(chosen, _learnt, "seen array<int>, ends array<int>, labels array<int>").limit(2 * sample).collect()
    return [([np.array(p) for p in np.split(np.array(r.seen), r.ends[:-1])], list(r.labels)) for r in sorted(rows)]


class Chain:
    """Weights of the field: one per feature and label, and one per pair of neighbouring labels."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def scores(self, seen: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[s].sum(axis=0) for s in seen])

    def decode(self, seen: list[np.ndarray]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        scores, steps = self.scores(seen).tolist(), self.steps.tolist()
        (a, b), back = scores[0], []
        for x, y in scores[1:]:
            from_a, from_b = a + steps[0][0] >= b + steps[1][0], a + steps[0][1] >= b + steps[1][1]
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = x + (a + steps[0][0] if from_a else b + steps[1][0]), y + (a + steps[0][1] if from_b else b + steps[1][1])
        labels = [int(b > a)]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def fit(pages: list[tuple[list[np.ndarray], list[int]]], rounds: int = ROUNDS, ridge: float = RIDGE) -> Chain:
    """Maximum likelihood with a ridge, by gradient steps of adapted size over all pages at once."""
    pages = [(seen, labels) for seen, labels in pages if seen]
    longest = max(len(labels) for _, labels in pages)
    count = len(pages)
    there = np.zeros((count, longest), bool)
    gold = np.zeros((count, longest), np.int64)
    row, slot, feature = [], [], []
    for i, (seen, labels) in enumerate(pages):
        there[i, : len(labels)], gold[i, : len(labels)] = True, labels
        for j, s in enumerate(seen):
            row += [i] * len(s)
            slot += [j] * len(s)
            feature += s.tolist()
    row, slot, feature = np.array(row), np.array(slot), np.array(feature)
    place = row * longest + slot
    theta = np.zeros((DIMENSIONS + 2, 2))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    pairs = there[:, 1:]
    wanted = np.zeros((2, 2))
    np.add.at(wanted, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    blocks = there.sum()
    for turn in range(1, rounds + 1):
        weights, steps = theta[:-2], theta[-2:]
        score = np.stack([np.bincount(place, weights[feature, k], count * longest) for k in (0, 1)], 1).reshape(count, longest, 2)
        ahead, behind = score.copy(), np.zeros_like(score)
        for t in range(1, longest):
            carried = np.logaddexp.reduce(ahead[:, t - 1, :, None] + steps, axis=1)
            ahead[:, t] = np.where(there[:, t, None], score[:, t] + carried, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            carried = np.logaddexp.reduce(steps + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(there[:, t + 1, None], carried, 0)
        single = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
        double = np.exp(
            ahead[:, :-1, :, None] + steps + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * pairs[:, :, None, None]
        miss = np.eye(2)[gold] * there[:, :, None] - single
        grad = np.zeros_like(theta)
        for k in (0, 1):
            grad[:-2, k] = np.bincount(feature, miss.reshape(-1, 2)[place, k], DIMENSIONS)
        grad[-2:] = wanted - double.sum(axis=(0, 1))
        grad = grad / blocks - ridge / 100 * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta += 0.1 * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    return Chain(theta[:-2].copy(), theta[-2:].copy())


def main_text(html: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(html)
    labels = chain.decode(features(blocks)) if blocks else []
    return "\n".join(b.text for b, keep in zip(blocks, labels) if keep)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; trains on the module's labelled pages unless given a chain."""
    if chain is None:
        chain = fit(TEACHING_WEIGHT * teaching_pages() + labelled_pages(pages))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, chain) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
