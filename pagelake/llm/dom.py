"""Leaf blocks of an HTML page: a forgiving reading of tags, enough to know each text's ancestors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[^<]+|<""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

# Element names by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
SKIPPED = frozenset("noscript template iframe svg object".split())
FORM = frozenset("select option".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "head"}
_SIBLINGS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


@dataclass
class Block:
    """Text of one block, the tags around it (outermost first), their class, id and role words, and its text in links."""

    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    linked: int = 0


@dataclass
class _Reader:
    open: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    blocks: list[Block] = field(default_factory=list)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and not any(t in FORM for t, _ in self.open):
            tags = tuple(t for t, _ in self.open)
            self.blocks.append(Block(text, tags, tuple(w for _, ws in self.open for w in ws), self.linked))
        self.parts, self.linked = [], 0

    def close(self, tag: str, within: set[str] | frozenset[str] = frozenset()) -> None:
        """Close the innermost ``tag``, unless one of ``within`` is nearer."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                del self.open[i:]
                return
            if name in within:
                return

    def leave_form(self) -> None:
        for i, (name, _) in enumerate(self.open):
            if name in FORM:
                del self.open[i:]
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK or tag in FORM:
            self.flush()
        if tag in BLOCK or tag == "select":  # form values hold no blocks
            self.leave_form()
        elif tag == "option":
            self.close("option")
        if tag in _ENDS_P:
            self.close("p", BLOCK - {"p"})
        if tag in _SIBLINGS:
            for other in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                self.close(other, _SIBLINGS[tag])
        if tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            words = tuple(w for _, v in _ATTRIBUTE.findall(attributes) for w in re.split(r"[^a-z]+", v.lower()) if w)
            self.open.append((tag, words))

    def end(self, tag: str) -> None:
        if tag in BLOCK or any(t in FORM for t, _ in self.open):
            self.flush()
        self.close(tag)


def _after(html: str, at: int, tag: str, around: set[str]) -> tuple[int, bool]:
    """Where an element that began before ``at`` ends, and whether its end tag was seen.

    After its end tag, or before that of a block around it; -1 if there is neither.
    """
    depth, seen = dict.fromkeys({tag, *around}, 0), False
    for m in _TOKEN.finditer(html, at):
        name = (m.group(2) or "").lower()
        if name not in depth:
            continue
        if not m.group(1):
            depth[name] += not m.group(3).endswith("/")
        elif depth[name]:
            depth[name] -= 1
            seen = seen or name == tag
        else:
            return (m.end(), True) if name == tag else (m.start(), seen)
    return -1, seen


def leaf_blocks(html: str | None) -> list[Block]:
    """Blocks in page order; scripts, styles, comments, hidden text and form values are none.

    Without an end tag, a script, style, textarea or title goes to the end of the page, as in browsers;
    an svg, object, iframe, noscript or template to the end of the block around it; an option to the next
    option, a block or its parent's end; a select to a block or its parent's end.
    """
    reader, at, html, endless = _Reader(), 0, html or "", set()
    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text == "<" or text[0] != "<":
                text = unescape(text) if "&" in text else text
                reader.parts.append(text)
                if any(t == "a" for t, _ in reader.open):
                    reader.linked += len(text)
        elif m.group(1):
            reader.end(tag.lower())
        elif tag.lower() in RAW:
            if not m.group(3).endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = close.end() if close else len(html)
        elif tag.lower() in SKIPPED:
            name = tag.lower()
            if not m.group(3).endswith("/") and name not in endless:
                end, seen = _after(html, at, name, {t for t, _ in reader.open if t in BLOCK})
                if end >= 0:
                    at = end
                elif not seen:
                    endless.add(name)  # nothing closes it: only its tag is left out
        else:
            reader.start(tag.lower(), m.group(3))
    reader.flush()
    return reader.blocks
