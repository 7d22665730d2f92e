"""Main text of web pages with wrappers inferred from pages of the same host.

A page becomes a stream of tokens: opening and closing tags with their classes, and texts by hash.
Runs of like elements fold into one repeated group. A wrapper is a union-free expression over
such tokens: each is required or optional, single or repeated, and a text is either fixed or a
slot. Wrappers grow by alignment: the common tokens of a wrapper and a page (or another wrapper)
stay, what only one of them has becomes optional, and texts that differ become slots. Aligning is
commutative enough to be done by parts, so the tasks fold pages into partial wrappers and the
wrappers of a host meet afterwards: a host with a third of all pages is spread over many tasks.

Extraction parses the page again and drops what the tags say is not article (menus, footers,
forms, scripts, ...) and, inside an article's container as well as outside, what the wrapper says
is template: texts that are fixed on the host. Fixed is a share of all distinct pages of the host, not of
the few that have such an element; pages of one host with the same text count once, so copies of an
article do not make it a template. A fixed text goes only if something else speaks for a notice, an advert
or a menu: it stands at the edge of the article, it is all links, or its kind of element holds nothing else on the
page. Headings with the article's own text after them stay, whatever their share.

A wrapper holds a bounded number of tokens. What is fixed on a host is also counted in a table
without bounds: for each place, an element with its neighbours or without, on how many of the host's
pages a text stands there. So the bound costs no page its menu or footer and no article a line.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import arrow_column, as_bytes, settle, struct_of, without
from caseloom.llm.url_filter import split_url

#: Partial wrappers of one host; bounds what one task folds of it, not what is folded.
SALTS = 64
#: Tokens of a wrapper. Longer alignments would add optional groups that hardly any page shares; such a
#: wrapper keeps the tokens that most pages had; fixed texts beyond them come from the table of places.
MOST_TOKENS = 400
#: Distinct pages a text must be on, in the same place, to count as fixed.
LEAST_PAGES = 3
#: Share of all distinct pages of the host that have a text in one place, for it to count as fixed inside an
#: article's container, and on pages without one.
FIXED_SHARE = 0.8
LOOSE_SHARE = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption summary legend figcaption".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object select".split())
SKIPPED = frozenset("head nav header footer aside form button input dialog menu script style textarea title noscript template iframe svg math canvas "
                    "object select option audio video".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag of the first closes an open element of the second.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option", "summary", "figcaption"}
#: Classes and ids of what surrounds an article. A name counts if all its parts do, beside parts that only say where
#: or what kind of box it is: "site-footer" does, "has-sidebar" and "post-with-comments" do not.
AROUND = re.compile(
    r"(?:^|(?<=\s))(?:{0}[_-]+)*(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|respond|replies|discussion|consent|cookie|cookies|"
    r"disclaimer|footer|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|pagination|pager|popup|promo|promoted|related|share|sharing|"
    r"sidebar|social|sponsor|sponsored|subscribe|subscription|toolbar|widget|widgets|alert|login|signup|search|skip|hidden)(?:[_-]+(?:{0}|{1}))*(?:$|(?=\s))".format(
        r"(?:site|page|main|global|primary|secondary|top|bottom|left|right|inner|outer|user|blog|post|article|google|[0-9]+)",
        r"(?:ad|ads|banner|bar|block|box|button|buttons|comments|consent|container|area|content|footer|form|group|icons|item|items|link|links|list|menu|modal|nav|navigation|"
        r"notice|panel|popup|post|posts|section|sidebar|signup|slot|text|to|unit|widget|widgets|wrap|wrapper)"), re.I)
#: The same outside an article only: in one, they hold its title.
HEADERS = re.compile(r"(?:^|[\s_-])(?:header|masthead|side|top|tags)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([A-Za-z][^\s/>]*)[^>]*(?:>|$)|<([A-Za-z][^\s/>]*)((?:\s*=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A piece of text with the elements around it."""

    path: tuple[str, ...]
    text: str
    around: bool
    inside: bool
    #: All of its text is links.
    linked: bool = False

    @property
    def heading(self) -> bool:
        return bool(self.path) and self.path[-1].split(".", 1)[0] in HEADINGS


def _named(attributes: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        out.setdefault(m[1].lower(), html.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""))
    return out


@dataclass
class _Open:
    tag: str
    label: str
    around: bool
    inside: bool
    #: Around by class names or ids alone, which an article or main element inside overrules.
    guessed: bool = False


def _element(tag: str, attributes: str, parent: _Open | None) -> _Open:
    label, around, inside, guessed = tag, tag in SKIPPED, tag in ("article", "main"), False
    own = inside
    if attributes.strip():
        a = _named(attributes)
        named = f"{a.get('class', '')} {a.get('id', '')}".strip()
        if named:
            label = f"{tag}.{_SPACE.sub('.', re.sub(r'[0-9]+', '0', named))}"
        if tag not in ("article", "main", "body", "html"):
            around = around or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", "")))
            guessed = not around and (bool(AROUND.search(named)) or bool(HEADERS.search(named) and not (parent and parent.inside)))
            around = around or guessed
        # an article may be a comment among comments
        own = own and not AROUND.search(named)
        inside = inside or a.get("role", "").lower() in ("main", "article") or bool(ARTICLE.search(named)) and not around and tag not in ("body", "html")
    # a header inside an article holds its title; one outside is the site's
    if tag == "header" and parent is not None and parent.inside and not parent.around:
        around = False
    if parent is not None and parent.around and not (own and parent.guessed):
        guessed = parent.guessed and (guessed or not around)
        around = True
    return _Open(tag, label, around, inside or bool(parent and parent.inside), guessed)


def parse(page: str) -> list[Block]:
    """Blocks of a page in order. Unclosed and misnested tags end where their container does."""
    blocks: list[Block] = []
    stack: list[_Open] = []
    words: list[str] = []
    plain: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
        words.clear()
        if text:
            top = stack[-1] if stack else _Open("", "", False, False)
            held = [e for e in stack if e.tag in BLOCKS]
            blocks.append(Block(tuple(e.label for e in held), text, top.around, top.inside, not plain))
        plain.clear()

    def add(text: str) -> None:
        """Text of the block, unless an element inside the block is itself around the article."""
        if stack and stack[-1].around and not next((e.around for e in reversed(stack) if e.tag in BLOCKS), False):
            return
        words.append(text)
        if text.strip() and not plain and not any(e.tag == "a" for e in stack):
            plain.append(text)

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.end()
        closing, opening = found[1], found[2]
        if closing:
            tag = closing.lower()
            if tag in BLOCKS or tag in SKIPPED:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if depth is not None and (tag in BLOCKS or tag in SKIPPED or not any(e.tag in BLOCKS for e in stack[depth + 1:])):
                if any(e.tag in BLOCKS for e in stack[depth:]):
                    flush()
                del stack[depth:]
        elif opening:
            tag = opening.lower()
            if tag == "br":
                words.append(" ")
                continue
            if tag in BLOCKS or tag in SKIPPED:
                flush()
                shut = IMPLIED.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in shut:
                        del stack[i:]
                        break
                    if stack[i].tag in ("table", "ul", "ol", "dl", "div", "article", "section", "main", "body") and stack[i].tag not in shut:
                        break
            if tag in ("svg", "math") and found[3].rstrip().endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                stop = end.start() if end else size
                at = page.find(">", stop) + 1 if end and page.find(">", stop) >= 0 else size
                continue
            if tag not in VOID and not found[3].rstrip().endswith("/"):
                stack.append(_element(tag, found[3], stack[-1] if stack else None))
    flush()
    return blocks


@dataclass
class Token:
    """One place of a wrapper: the elements around, whether pages may lack or repeat it, its text."""

    label: str
    text: int | None
    repeated: bool = False
    optional: bool = False
    pages: int = 1
    #: Of a page's token, the texts of its blocks.
    held: list[int] = field(default_factory=list, compare=False)


@dataclass
class Wrapper:
    tokens: list[Token] = field(default_factory=list)
    pages: int = 0

    def packed(self) -> bytes:
        rows = [f"{t.label}\t{'' if t.text is None else t.text}\t{int(t.repeated)}{int(t.optional)}\t{t.pages}\t{','.join(map(str, t.held))}" for t in self.tokens]
        return zlib.compress("\n".join([str(self.pages), *rows]).encode(), 1)

    @staticmethod
    def unpacked(data: bytes) -> Wrapper:
        first, *rows = zlib.decompress(data).decode().split("\n")
        tokens = []
        for row in rows:
            label, text, flags, pages, held = row.split("\t")
            tokens.append(Token(label, int(text) if text else None, flags[0] == "1", flags[1] == "1", int(pages), [int(h) for h in held.split(",")] if held else []))
        return Wrapper(tokens, int(first))


def hashed(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) << 16 | len(text) & 0xFFFF


def folded(blocks: Iterable[Block]) -> list[tuple[Token, list[int]]]:
    """Tokens of one page with the numbers of their blocks: runs of like elements are one repeated token, its
    text fixed as a whole."""
    out: list[tuple[Token, list[int]]] = []
    texts: list[list[str]] = []
    for i, b in enumerate(blocks):
        label = "/".join(b.path).replace("\t", " ").replace("\n", " ")
        if out and out[-1][0].label == label:
            out[-1][0].repeated = True
            out[-1][1].append(i)
            texts[-1].append(b.text)
        else:
            out.append((Token(label, None), [i]))
            texts.append([b.text])
    for (token, _), held in zip(out, texts, strict=True):
        token.held = [hashed(text) for text in held]
        token.text = token.held[0] if len(held) == 1 else hashed("\n".join(held))
    return out


def _number(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\t".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def places(tokens: list[Token]) -> set[tuple[int, int]]:
    """(place, text) of a page. A run of like elements stands between its neighbours, each of its blocks wherever the
    page has such an element. A text's number covers its element."""
    out: set[tuple[int, int]] = set()
    for before, t, after in zip(["", *[t.label for t in tokens[:-1]]], tokens, [*[t.label for t in tokens[1:]], ""], strict=False):
        out.add((_number(before, t.label, after), _number(t.label, t.text)))
        out.update((_number(t.label), _number(t.label, text)) for text in t.held)
    return out


def content(blocks: list[Block]) -> int:
    """Identity of what a page says, whatever surrounds it: copies of an article are one page of evidence."""
    texts = [b.text for b in blocks if b.inside and not b.around] or [b.text for b in blocks if not b.around]
    return int.from_bytes(hashlib.blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def aligned(one: Wrapper, other: Wrapper) -> Wrapper:
    """The wrapper both fit: common tokens stay, others become optional, unlike texts become slots."""
    if not one.pages or not other.pages:
        return one if one.pages else other
    out: list[Token] = []

    def lone(tokens: list[Token]) -> None:
        out.extend(Token(t.label, t.text, t.repeated, True, t.pages) for t in tokens)

    matcher = SequenceMatcher(None, [t.label for t in one.tokens], [t.label for t in other.tokens], autojunk=False)
    for kind, a, b, c, d in matcher.get_opcodes():
        if kind == "equal":
            for x, y in zip(one.tokens[a:b], other.tokens[c:d], strict=True):
                out.append(Token(x.label, x.text if x.text == y.text else None, x.repeated or y.repeated, x.optional or y.optional, x.pages + y.pages))
        else:
            lone(one.tokens[a:b])
            lone(other.tokens[c:d])
    if len(out) > MOST_TOKENS:
        least = sorted((t.pages for t in out), reverse=True)[MOST_TOKENS - 1]
        out = [t for t in out if t.pages >= least][:MOST_TOKENS]
    return Wrapper(out, one.pages + other.pages)


def _fits(wrapper: Wrapper, page: list[tuple[Token, list[int]]]) -> bool:
    """Whether a page matches token by token, which spares the alignment."""
    return [t.label for t in wrapper.tokens] == [t.label for t, _ in page]


def grown(wrapper: Wrapper, page: list[tuple[Token, list[int]]]) -> Wrapper:
    if wrapper.pages and _fits(wrapper, page):
        for t, (p, _) in zip(wrapper.tokens, page, strict=True):
            t.text = t.text if t.text == p.text else None
            t.repeated |= p.repeated
            t.pages += 1
        wrapper.pages += 1
        return wrapper
    return aligned(wrapper, Wrapper([t for t, _ in page], 1))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, identity and tokens of each page, without its texts."""
    for batch in batches:
        hosts, contents, tokens = [], [], []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            blocks = parse(page.as_py().decode("utf-8", "replace"))
            hosts.append(split_url(url)[0])
            contents.append(content(blocks))
            tokens.append(Wrapper([t for t, _ in folded(blocks)], 1).packed())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(tokens, pa.binary())], names=["host", "content", "tokens"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers of the hosts a task meets; handed on whenever there are many."""
    held: dict[str, Wrapper] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([w.packed() for w in held.values()], pa.binary())], names=["host", "wrapper"])

    for batch in batches:
        for host, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[host] = grown(held.get(host) or Wrapper(), [(Token(t.label, t.text, t.repeated), []) for t in Wrapper.unpacked(tokens).tokens])
        if len(held) > 2_000:
            yield out()
            held.clear()
    if held:
        yield out()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and texts of the pages a task meets."""
    for batch in batches:
        hosts, at, texts = [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(at, pa.int64()), pa.array(texts, pa.int64())], names=["host", "place", "text"])

        for host, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for place, text in places(Wrapper.unpacked(tokens).tokens):
                hosts.append(host)
                at.append(place)
                texts.append(text)
            if len(at) > 100_000:
                yield out()
                hosts, at, texts = [], [], []
        yield out()


def _fixed(distinct: DataFrame) -> DataFrame:
    """(host, fixed): the numbers of the texts that stand in one place on half of a host's pages or more, with 1 behind those
    that do on nearly all. There are at most twice as many as a page has blocks on average, so a host's row does not
    grow with its pages."""
    seen = distinct.select("host", "tokens").mapInArrow(_placed, "host string, place bigint, text bigint")
    counted = seen.groupBy("host", "place", "text").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    whole = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    often = counted.join(whole, "host").where(F.col("n") >= LOOSE_SHARE * F.col("pages"))
    best = often.groupBy("host", "text").agg(F.max((F.col("n") >= FIXED_SHARE * F.col("pages")).cast("int")).alias("all"))
    return best.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "text", "all"))), ",").alias("fixed"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges neighbouring wrappers of a host in sorted input; keeps one at a time."""
    host, wrapper = None, Wrapper()
    done: list[tuple[str, bytes]] = []
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != host:
                if host is not None:
                    done.append((host, wrapper.packed()))
                host, wrapper = name, Wrapper()
            wrapper = aligned(wrapper, Wrapper.unpacked(data))
        if len(done) > 1_000:
            yield _hosts(done)
            done = []
    if host is not None:
        done.append((host, wrapper.packed()))
    yield _hosts(done)


def _hosts(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["host", "wrapper"])


def infer_wrappers(pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """(host, wrapper, fixed) of every host, from all its pages. The pages of unreadable urls are one host, ``""``.

    Pages move without their texts, to meet their copies. What is left folds where it lies; then only wrappers
    move, a host's first to ``salts`` tasks, then to one.
    """
    kind = "host string, wrapper binary"
    read = pages.select(F.col("url").cast("string").alias("url"), as_bytes("html").alias("html"))
    pages = read.mapInArrow(_skeletons, "host string, content bigint, tokens binary")
    # of copies the least is taken, so that a task that runs again meets the same tokens
    distinct = settle(pages.groupBy("host", "content").agg(F.min("tokens").alias("tokens")), "skeletons")
    partial = distinct.select("host", "tokens").mapInArrow(_partial, kind)
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).repartition("host", "salt").sortWithinPartitions("host", "salt")
    fewer = salted.select("host", "wrapper").mapInArrow(_merged, kind)
    whole = fewer.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_merged, kind)
    return whole.join(_fixed(distinct), "host", "left")


def main_text(page: str, wrapper: Wrapper | None, fixed: dict[int, bool] | None = None) -> str:
    """The article's blocks joined by blank lines.

    What the tags exclude goes, and of what is fixed on the host what looks like a template (``_template``). If an
    article container holds some of the rest, the article is what it holds; else it is all the rest. A host with too few
    pages has nothing fixed.
    """
    blocks = parse(page)
    own = folded(blocks)
    # of each block: 2 fixed on nearly all pages of the host, 1 on half of them or more, 0 neither
    share = [0] * len(blocks)
    if wrapper is not None and wrapper.pages >= LEAST_PAGES:
        for known, (token, numbers) in _places(wrapper, own):
            if known.text is not None and known.text == token.text and known.pages >= max(LEAST_PAGES, LOOSE_SHARE * wrapper.pages):
                for i in numbers:
                    share[i] = 2 if known.pages >= FIXED_SHARE * wrapper.pages else 1
    if fixed:
        for token, numbers in own:
            whole = fixed.get(_number(token.label, token.text))
            for i, text in zip(numbers, token.held, strict=True):
                one = fixed.get(_number(token.label, text))
                if whole is not None or one is not None:
                    share[i] = max(share[i], 2 if whole or one else 1)
    kept = [i for i, b in enumerate(blocks) if not b.around]
    held = [i for i in kept if blocks[i].inside]
    article = _without_template(blocks, held, share, 2)
    if not any(blocks[i].inside for i in article):
        article = _without_template(blocks, kept, share, 1)
    return "\n\n".join(blocks[i].text for i in article)


def _without_template(blocks: list[Block], numbers: list[int], share: list[int], least: int) -> list[int]:
    """The numbers of blocks that stay, in order. A fixed block goes if it stands at an edge, is all links, or if all blocks of
    its kind on the page are fixed. A fixed heading goes if nothing but such blocks follows it; where no container
    bounds the article (``least`` 1), also if nothing else comes before it."""
    fixed = {i for i in numbers if share[i] >= least}
    if not fixed:
        return numbers
    own_kinds = {blocks[i].path for i in numbers if i not in fixed}
    times = Counter((blocks[i].path, blocks[i].text) for i in numbers)
    # a text of the article's own kind is a template at an edge if nearly all pages have it, and this one once
    edged = {i for i in fixed if blocks[i].heading or blocks[i].linked or blocks[i].path not in own_kinds
             or share[i] == 2 and times[blocks[i].path, blocks[i].text] == 1}
    gone: set[int] = {i for i in fixed if not blocks[i].heading and (blocks[i].linked or blocks[i].path not in own_kinds)}
    for i in numbers:  # the leading edge
        if i not in edged:
            break
        if not blocks[i].heading or least == 1:
            gone.add(i)
    own = False  # whether a block of the article's own kinds came after
    for i in reversed(numbers):  # the trailing edge
        if i not in edged:
            break
        if not blocks[i].heading:
            own |= blocks[i].path in own_kinds and not blocks[i].linked
            gone.add(i)
        elif not own:
            gone.add(i)
    return [i for i in numbers if i not in gone]


def _places(wrapper: Wrapper, page: list[tuple[Token, list[int]]]) -> Iterator[tuple[Token, tuple[Token, list[int]]]]:
    """Tokens of the wrapper beside those of a page that take their places."""
    if _fits(wrapper, page):
        yield from zip(wrapper.tokens, page, strict=True)
        return
    matcher = SequenceMatcher(None, [t.label for t in wrapper.tokens], [t.label for t, _ in page], autojunk=False)
    for a, b, n in matcher.get_matching_blocks():
        yield from zip(wrapper.tokens[a:a + n], page[b:b + n], strict=True)


def _extract(pages: pa.Array, wrappers: pa.Array, fixed: pa.Array) -> pa.Array:
    texts, sizes, known, last = [], [], None, None
    for page, packed, numbers in zip(pages, wrappers, fixed, strict=True):
        host = packed.as_py(), numbers.as_py()
        if host != last:
            pairs = (x.split(":") for x in host[1].split(",")) if host[1] else ()
            known = host[0] and Wrapper.unpacked(host[0]), {int(number): nearly == "1" for number, nearly in pairs}
            last = host
        text = main_text(page.as_py().decode("utf-8", "replace"), *known)
        texts.append(text)
        sizes.append(len(text))
    return struct_of(text=(texts, pa.string()), n_chars=(sizes, pa.int64()))


def extract_pages(pages: DataFrame, most_broadcast: int = 2_000) -> DataFrame:
    """The pages, without html, with ``text`` and ``n_chars``, its code points.

    Null and empty html give an empty text. Input columns named like the new ones are replaced;
    every row stays, repeated ones too. Up to ``most_broadcast`` hosts' wrappers are broadcast;
    more are joined by host, where Spark splits a host with many pages.
    """
    pages = without(pages, "text", "n_chars", "host", "wrapper", "fixed")
    wrappers = settle(infer_wrappers(pages), "wrappers")
    host = F.translate(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = F.broadcast(wrappers) if wrappers.count() <= most_broadcast else wrappers
    joined = pages.withColumn("host", host).join(known, "host", "left")
    done = joined.withColumn("_t", arrow_column(_extract, "struct<text:string,n_chars:bigint>", as_bytes("html"), F.col("wrapper"), F.col("fixed")))
    return done.select(*[F.col(f"`{c}`") for c in pages.columns if c != "html"], "_t.*")
