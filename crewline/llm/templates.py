"""Main text of web pages by template deduction from equivalence classes of tokens within a host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from crewline.llm.common import materialize


@dataclass(frozen=True)
class Template:
    """A class belongs to the template of a host of at least ``pages`` pages when it is on a share of them and has ``tokens`` tokens."""

    pages: int = 5
    share: float = 0.6
    tokens: int = 2
    # Within an article, text of more words is content, wherever it repeats.
    words: int = 12


# Elements of HTML, and names that pages give to parts around the article.
RAW = "script style textarea noscript template svg iframe title object select"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form button menu dialog label fieldset".split()) | frozenset(RAW.split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_NEXT = {"p": frozenset(BLOCKS), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header"
    " login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager paywall popup promo promoted promotion"
    " reactions recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser"
    " toolbar topbar widget widgets".split()
)
# In front of a name these tell where on the page the part is.
SIDES = frozenset("bottom global left main mobile page primary right secondary site top".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript|template|svg|iframe|title|object|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)",
    re.S | re.I,
)
HEADING = re.compile(r"(?:^|/)h[1-6]$")
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


@dataclass
class Block:
    """A stretch of text between block borders: its text, where it stands, whether around the article, and the share of its text in links."""

    text: str
    path: str
    dropped: bool
    within: str
    linked: int
    named: tuple[int, ...] = ()
    main: int = -1


def _around(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds something other than the article."""
    if name in DROPPED or (name == "header" and not inside):
        return True
    if not attributes.strip():
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "role" and value in ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attributes))


def _named(name: str, attributes: str, inside: bool) -> bool:
    """Whether a class or id names an element as a part around the article: as a whole, by its first word, or by its second after a side."""
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id"):
            for token in (a or b or c).lower().split():
                words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
                if len(words) == 2 and words[0] in SIDES:
                    words = words[1:]
                # A header within the article holds its title.
                if words and words[0] in NAMES and not (inside and words[0] == "header"):
                    return True
    return False


def _drop_named(blocks: list[Block], mains: list[tuple[bool, tuple[int, ...]]], places: list[int]) -> None:
    """Drop what lies in named elements, but for those that hold the article or most of the page's unlinked text.

    The article is the ``article`` element (else the main part) with most of the page's text, else the longest, first one
    outside named elements. On a page with an article, text of others counts for nothing.
    """
    inside, own, total = [0] * len(places), [0] * len(mains), 0
    for b in blocks:
        if not b.dropped:
            size = max(b.text.count(" ") + 1 - b.linked, 0)
            total += size
            for i in b.named:
                inside[i] += size
            if b.main >= 0:
                own[b.main] += size
    best = max((i for i in range(len(mains)) if own[i]), key=lambda i: (mains[i][0], 2 * own[i] > total, not mains[i][1], own[i]), default=-1)
    kept = set(mains[best][1]) if best >= 0 else set()
    for i, size in enumerate(inside):
        if 2 * size > total and (best < 0 or not mains[best][0] or places[i] == best):
            kept.add(i)
    for b in blocks:
        b.dropped = b.dropped or not kept.issuperset(b.named)


def parse(page: str | None) -> list[Block]:
    """Blocks of a page in order. Unclosed and stray tags are taken as browsers do, in simple form; raw elements and comments are passed over."""
    blocks: list[Block] = []
    # Name, dropped from here on, innermost article or main, numbers of the named elements around, number of the outermost article or main.
    stack: list[tuple[str, bool, str, tuple[int, ...], int]] = []
    mains: list[tuple[bool, tuple[int, ...]]] = []  # whether an article, and the named elements around
    places: list[int] = []  # of each named element the article or main around
    parts: list[str] = []
    linked = 0

    def close_block():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                state = stack[-1][1:] if stack else (False, "", (), -1)
                blocks.append(Block(text, "/".join(s[0] for s in stack if s[0] in BLOCKS), *state[:2], linked, *state[2:]))
            parts, linked = [], 0

    def pop(to: int):
        for name, *_ in reversed(stack[to:]):
            if name in BLOCKS:
                close_block()
        # What is dropped ends with its element, also for text directly before.
        if any((a[1], a[3]) != ((stack[to - 1][1], stack[to - 1][3]) if to else (False, ())) for a in stack[to:]):
            close_block()
        del stack[to:]

    for match in TOKEN.finditer(page or ""):
        raw, closing, name, attributes, text = match.groups()
        if text is not None:
            parts.append(text)
            if any(s[0] == "a" for s in stack[-4:]):
                linked += len(text.split())
            continue
        if raw is not None or name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        if name in VOID:
            if name == "hr":
                close_block()
            continue
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                pop(at)
            continue
        # A paragraph, an item or a cell that was left open ends where the next begins.
        while stack and stack[-1][0] in CLOSED_BY_NEXT and name in CLOSED_BY_NEXT[stack[-1][0]]:
            pop(len(stack) - 1)
        if name in BLOCKS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSED_BY_NEXT and name in CLOSED_BY_NEXT[stack[i][0]]:
                    pop(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
            close_block()
        dropped, within, named, main = stack[-1][1:] if stack else (False, "", (), -1)
        own = dropped or _around(name, attributes or "", bool(within))
        part = not own and name not in ("html", "body", "main") and bool(attributes) and _named(name, attributes, bool(within))
        # A named article stays, but below a named element it is a comment or a teaser and not the one looked for.
        other, part = part and name == "article" and bool(named), part and name != "article"
        if own != dropped or part:
            close_block()
        if (attributes or "").rstrip().endswith("/"):
            continue
        if part:
            named = (*named, len(places))
            places.append(main)
        if name in ("article", "main") or 'role="main"' in (attributes or ""):
            inner = "article" if name == "article" or within == "article" else "main"
            if inner != within and not other:
                main = len(mains)
                mains.append((inner == "article", named))
            within = inner
        stack.append((name, own, within, named, main))
    close_block()
    if places:
        _drop_named(blocks, mains, places)
    return blocks


def _host(url: Column) -> Column:
    """Host of an address; empty without one."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def _tokens(blocks: list[Block]) -> list[int]:
    """Tokens of a page in order: of each block its place (the tags around), and its text in that place."""
    out = []
    for b in blocks:
        out.append(_hash(b.path))
        out.append(_hash(f"{b.path}\0{b.text}"))
    return out


def _sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bodies = [_hash(page or "") for page in batch["html"]]
        numbers = [_hash(f"{number}\0{body}") for number, body in zip(batch["page_id"], bodies)]
        yield pd.DataFrame({"host": batch["host"], "page": numbers, "body": bodies, "tokens": [_tokens(parse(page)) for page in batch["html"]]})


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each token of a host with a fingerprint of how often it is on which page, summed over the batch."""
    for batch in batches:
        rows: dict[tuple[str, int], list] = {}
        for host, page, body, tokens in zip(batch["host"], batch["page"], batch["body"], batch["tokens"]):
            counts: dict[int, int] = {0: 1}  # 0: the page itself
            for token in tokens.tolist():
                counts[token] = counts.get(token, 0) + 1
            marks: dict[int, int] = {}
            for token, n in counts.items():
                if n not in marks:
                    marks[n] = _hash(f"{page}\0{n}")
                row = rows.get((host, token))
                if row is None:
                    rows[(host, token)] = [marks[n], 1, body, body]
                else:
                    row[0] ^= marks[n]
                    row[1] += 1
                    row[2], row[3] = min(row[2], body), max(row[3], body)
        yield pd.DataFrame([(h, t, *r) for (h, t), r in rows.items()], columns=["host", "token", "mark", "pages", "least", "most"])


def _roles(classes) -> dict[int, tuple[int, int]]:
    """Of each token of a host's classes the class and the place in it."""
    return {token: (c["class"], i) for c in classes for i, token in enumerate(np.asarray(c["tokens"]).tolist())}


def _before(places: list[list[int]]) -> np.ndarray:
    """Which tokens of a class stand before which on a page, in each turn of the class."""
    turns = np.array([len(x) for x in places])
    out = np.zeros((len(places), len(places)), bool)
    for n in set(turns.tolist()) - {0}:
        own = np.flatnonzero(turns == n)
        at = np.array([places[i] for i in own])
        ahead = (at[:, None, :] < at[None, :, :]).all(2)
        if n > 1:
            ahead &= (at[None, :, :-1] < at[:, None, 1:]).all(2)
        out[np.ix_(own, own)] = ahead
    return out


def _orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each token of a class the ones that it stands before on all pages of the batch, as words of 64 bits."""
    for batch in batches:
        known: dict[str, tuple] = {}
        found: dict[tuple[str, int], np.ndarray] = {}
        for host, tokens, classes in zip(batch["host"], batch["tokens"], batch["classes"]):
            if host not in known:
                known[host] = (_roles(classes), {c["class"]: np.asarray(c["tokens"]) for c in classes})
            roles, members = known[host]
            places: dict[int, list[list[int]]] = {}
            for at, token in enumerate(tokens.tolist()):
                if token in roles:
                    c, i = roles[token]
                    places.setdefault(c, [[] for _ in members[c]])[i].append(at)
            for c, x in places.items():
                ahead = _before(x)
                found[host, c] = found[host, c] & ahead if (host, c) in found else ahead
        rows = []
        for (host, c), ahead in found.items():
            bits = np.zeros((len(ahead), -(-len(ahead) // 64) * 8), np.uint8)
            bits[:, : -(-len(ahead) // 8)] = np.packbits(ahead, axis=1, bitorder="little")
            for i, line in enumerate(bits.view(np.int64).tolist()):
                rows += [(host, c, i, int(known[host][1][c][i]), k, word) for k, word in enumerate(line)]
        yield pd.DataFrame(rows, columns=["host", "class", "i", "token", "k", "bits"])


def _chain(before: np.ndarray) -> list[int]:
    """A longest list of tokens of which each stands before all that follow."""
    size = np.ones(len(before), int)
    lists: list[list[int]] = [[] for _ in size]
    for b in np.argsort(before.sum(0), kind="stable").tolist():
        ahead = np.flatnonzero(before[:, b])
        a = next((a for a in ahead[np.argsort(-size[ahead], kind="stable")].tolist() if before[lists[a], b].all()), None)
        lists[b] = [b] if a is None else [*lists[a], b]
        size[b] = len(lists[b])
    return lists[int(np.argmax(size))]


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    """One class: its tokens in the order that all pages have."""
    rows = rows.sort_values(["i", "k"])
    tokens = rows.drop_duplicates("i")["token"].to_numpy()
    bits = rows["bits"].to_numpy().astype(np.int64).reshape(len(tokens), -1)
    before = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, : len(tokens)].astype(bool)
    return pd.DataFrame({"host": rows["host"].iloc[:1], "class": rows["class"].iloc[:1], "tokens": [tokens[_chain(before)].tolist()]})


def _nesting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each class whether it overlaps a larger one on a page, and the least and greatest of the slots around it."""
    for batch in batches:
        known: dict[str, tuple] = {}
        found: dict[tuple[str, int], list] = {}
        for host, tokens, classes in zip(batch["host"], batch["tokens"], batch["classes"]):
            if host not in known:
                known[host] = (_roles(classes), {c["class"]: len(c["tokens"]) for c in classes})
            roles, sizes = known[host]
            stack: list[list[int]] = []  # open classes, each with the place of the token to come
            for token in tokens.tolist():
                if token not in roles:
                    continue
                c, i = roles[token]
                here = found.setdefault((host, c), [False, 2**62, -1])
                if i == 0:
                    around = (stack[-1][0] + 1 << 31) + stack[-1][1] if stack else 0
                    here[1], here[2] = min(here[1], around), max(here[2], around)
                    stack.append([c, 1])
                    continue
                level = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), None)
                if level is None or stack[level][1] != i:
                    # Its turn was cut short by a class that it overlaps.
                    continue
                for other, _ in stack[level + 1 :]:
                    found[host, min((sizes[other], -other, other), (sizes[c], -c, c))[2]][0] = True
                del stack[level + 1 :]
                stack[level][1] += 1
                if stack[level][1] == sizes[c]:
                    stack.pop()
        yield pd.DataFrame([(h, c, *r) for (h, c), r in found.items()], columns=["host", "class", "overlaps", "least", "most"])


def _per_host(classes: DataFrame) -> DataFrame:
    return materialize(classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("class", "tokens"))).alias("classes")))


def templates(pages: DataFrame, p: Template) -> DataFrame:
    """``host, tokens``: the tokens of each host's template.

    1. Tokens with the same occurrence vector over the host's pages are a class; those that are large and on most pages are taken.
    2. A class is ordered: its tokens follow one another in the same order, turn by turn, on every page. Tokens that stand now here,
       now there are left out of it.
    3. Classes are nested: each lies within one slot (between the same two tokens of the innermost class around it) wherever it
       occurs. Of two that overlap the smaller goes, and so does one found in several slots, until all are nested.

    What is left is the template, a tree of classes and slots; the text of a page that is not in it fills the slots. A token is
    a place or the text between two tags as a whole: words of a text that repeats would all be of one class, and those of others fill
    a slot. A class is bounded by what a page can hold, as each token is on most pages; its order costs the square of that.
    """
    named = pages.select("page_id", _host(F.col("url")).alias("host"), "html")
    read = materialize(named.mapInPandas(_sequences, "host string, page long, body long, tokens array<long>"))
    counted = read.mapInPandas(_vectors, "host string, token long, mark long, pages long, least long, most long")
    vectors = counted.groupBy("host", "token").agg(
        F.bit_xor("mark").alias("mark"), F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    vectors = materialize(vectors.where((F.col("token") == 0) | ((F.col("least") != F.col("most")) & (F.col("pages") >= p.pages * p.share))))
    hosts = vectors.where("token = 0").select("host", F.col("pages").alias("all_pages"))
    frequent = vectors.where("token <> 0").join(hosts, "host").where((F.col("all_pages") >= p.pages) & (F.col("pages") >= F.col("all_pages") * p.share))
    classes = frequent.groupBy("host", "mark", "pages").agg(F.sort_array(F.collect_set("token")).alias("tokens")).where(F.size("tokens") >= p.tokens)
    numbered = classes.select("host", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "mark")).alias("class"), "tokens")

    bits = read.join(_per_host(numbered), "host").mapInPandas(_orders, "host string, class int, i int, token long, k int, bits long")
    bits = bits.groupBy("host", "class", "i", "token", "k").agg(F.bit_and("bits").alias("bits"))
    ordered = bits.groupBy("host", "class").applyInPandas(_ordered, "host string, class int, tokens array<long>")
    valid = _per_host(ordered.where(F.size("tokens") >= p.tokens))
    while True:
        seen = read.join(valid, "host").mapInPandas(_nesting, "host string, class int, overlaps boolean, least long, most long")
        seen = seen.groupBy("host", "class").agg(F.bool_or("overlaps").alias("overlaps"), (F.min("least") != F.max("most")).alias("moves"))
        # Classes that overlap go first: another may only seem to move because of them.
        judged = materialize(seen)
        gone = judged.where("overlaps")
        if not gone.take(1):
            gone = judged.where("moves")
            if not gone.take(1):
                break
        own = valid.select("host", F.explode("classes").alias("one")).select("host", "one.*")
        valid = _per_host(own.join(gone.select("host", "class"), ["host", "class"], "left_anti"))
    return valid.select("host", F.array_sort(F.flatten(F.col("classes.tokens"))).alias("tokens"))


def main_text(page: str | None, template: set[int], p: Template = Template()) -> str:
    """Text of the slots that hold the article, in page order.

    Blocks around the article go, and so do texts of the template. Of the rest, those within an article (or else the main part)
    stay; a page without either keeps its blocks that are not mostly links. Headings and long texts of an article are no template.
    """
    own = [b for b in parse(page) if not b.dropped]
    own = [b for b in own if (b.within and (b.text.count(" ") >= p.words or HEADING.search(b.path))) or _hash(f"{b.path}\0{b.text}") not in template]
    for within in ("article", "main"):
        if any(b.within == within for b in own):
            return "\n\n".join(b.text for b in own if b.within == within)
    return "\n\n".join(b.text for b in own if 2 * b.linked < len(b.text.split()) + 1)


def extract(pages: DataFrame, p: Template = Template()) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null page is empty; a page without a host is grouped with the others without one; a page on a host with few
    pages is judged by its elements alone. Repeated rows and copies of a page are extracted alike and make no
    template by themselves. Other columns play no part; an empty table gives no rows.
    """
    known = materialize(templates(pages, p))
    named = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    # Templates are few and written first, so their size is known: small ones are broadcast, others joined with skewed hosts split.
    found = named.join(known, "host", "left").select("page_id", "url", "html", "tokens")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(page, set() if tokens is None else set(np.asarray(tokens).tolist()), p) for page, tokens in zip(batch["html"], batch["tokens"])]
            yield batch[["page_id", "url"]].assign(text=text, n_chars=[len(t) for t in text])

    return found.mapInPandas(run, "page_id long, url string, text string, n_chars long")
