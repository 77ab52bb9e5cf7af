"""HTML extraction by nearest-URL page differencing.

Pages are put in order of host and path. Each is compared to its neighbour of the same host whose path agrees longest
with its own (the one before in a tie; pages with the very same lines tell nothing, so the neighbours are the nearest
before and after whose lines differ): their
lines (blocks of text) are aligned by longest common subsequence, and shared lines are deleted as the host's furniture.

Two rules from the markup correct what differencing alone gets wrong. Lines inside an article or main element stay even
if shared, since a host may print one text twice; lines in elements marked as furniture (navigation, page header,
footer, sidebar, notice, advert, form, reader comments) go even if unshared. Differencing decides all other lines, also on
pages with an article.

Order is dealt out by ranges of the key with the neighbouring range's edge page beside it, so no host meets in one task.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._util import discard, map_pandas, materialize, ordered_runs

# Element names and class words by role.
RAW = frozenset("script style noscript template textarea title iframe select".split())
FURNITURE = frozenset("head nav footer aside form menu dialog button".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose nesting is followed; the others never change what a line is.
NESTED = frozenset("div section span ul ol table header".split()) | FURNITURE | MAIN
MARKED = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies footer header menu nav navbar navigation newsletter notice notices popup promo related share sharing sidebar social sponsor sponsored subscribe".split())
#: First parts of a compound that name furniture whatever follows; others (related-work, share-price) need not.
MARKED_FIRST = frozenset("ad ads advert advertisement comment comments cookie cookies newsletter sidebar sponsor sponsored".split())
ROLES = frozenset("banner navigation contentinfo complementary search alert dialog form menu menubar".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
#: What a line is.
FURNISHED, PLAIN, ARTICLE = 0, 1, 2


def furniture_word(word: str, inside: bool) -> bool:
    """Whether a class or id names furniture: whole or in any part; inside an article whole, by its last part, which says
    what a compound is, or by a first part that leaves no doubt. An article's own header is none."""
    parts = re.split(r"[-_]+", word)
    if inside:
        return bool(MARKED.intersection([word, parts[-1]]) - {"header"} or parts[0] in MARKED_FIRST)
    return bool(MARKED.intersection([word, *parts]))


def marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is furniture: by its name, or by words of its class, id or role."""
    if name in FURNITURE or (name == "header" and not inside):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.strip() in ROLES):
            return True
        if key in ("class", "id") and any(furniture_word(w, inside) for w in value.split()):
            return True
    return False


def tag_end(page: str, at: int) -> int:
    """Where the tag that begins at ``at`` ends; a > inside a quoted value does not end it. -1: nowhere."""
    end = page.find(">", at)
    if end < 0:
        return -1
    quoted = page.find('"', at, end)
    if quoted >= 0 and page.count('"', at, end) % 2:
        close = page.find('"', end)
        again = page.find(">", close) if close >= 0 else -1
        # an unpaired quote is a slip, not a value, if another tag begins before it is closed
        if again >= 0 and page.find("<", end, close) < 0:
            return again
    return end


def lines(page: str) -> list[tuple[str, int]]:
    """The blocks of text of a page in order, each with what it is. Never fails: what is not a tag is text."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture, main: of it or of what it stands in
    at, n = 0, len(page)

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                _, furniture, main = stack[-1] if stack else ("", False, False)
                out.append((text, FURNISHED if furniture else ARTICLE if main else PLAIN))

    while at < n:
        start = page.find("<", at)
        if start < 0:
            held.append(page[at:])
            break
        if start > at:
            held.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        closing = after == "/"
        m = NAME.match(page, start + 1 + closing)
        end = tag_end(page, start) if m else -1
        if end < 0:
            held.append("<")
            at = start + 1
            continue
        name, at = m[0].lower(), end + 1
        if name in RAW:
            if not closing and page[end - 1] != "/":
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = n if close is None else close.end()
            continue
        if name == "br":
            held.append(" ")
        elif name in BLOCK:
            flush()
        if name not in NESTED or name in VOID:
            if name == "body" and not closing:
                stack.clear()  # a head left open ends here
            continue
        if closing:
            for k in reversed(range(len(stack))):
                if stack[k][0] == name:
                    flush()
                    del stack[k:]
                    break
        elif page[end - 1] != "/":
            _, furniture, main = stack[-1] if stack else ("", False, False)
            now = furniture or marked(name, page[m.end() : end], main)
            if now != furniture or name in MAIN:
                flush()
            stack.append((name, now, main or name in MAIN))
    flush()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Which lines of a are in a longest common subsequence with b: bit-parallel, a row of bits for each line of a."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    rows = [k for k in range(head, len(a) - tail) if a[k] in both]  # the others are in no common subsequence
    cols = [x for x in b[head : len(b) - tail] if x in both]
    where: dict[str, int] = {}
    for j, x in enumerate(cols):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(cols)) - 1
    v, steps = full, []
    for k in rows:
        u = v & where[a[k]]
        v = ((v + u) | (v - u)) & full
        steps.append(v)
    i, j = len(rows), len(cols)
    while i and j:  # a zero bit: the column adds one to the length
        if a[rows[i - 1]] == cols[j - 1]:
            out.add(rows[i - 1])
            i, j = i - 1, j - 1
        elif steps[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out


def agreement(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def main_text(own: list[tuple[str, int]], near: list[list[tuple[str, int]]]) -> str:
    """The text of a page given its neighbours, the nearest first."""
    texts = [t for t, _ in own]
    shared: set[int] = set()
    for other in near:
        if (theirs := [t for t, _ in other]) != texts:
            shared = common(texts, theirs)
            break
    # differencing; then the two corrections from the markup
    left = [k for k in range(len(own)) if k not in shared or own[k][1] == ARTICLE]
    left = [k for k in left if own[k][1] != FURNISHED]
    return "\n\n".join(texts[k] for k in left)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page: blocks joined by two newlines, white space inside a block as one space.

    Null html is empty and gives an empty text. A null url is a host of its own with empty path. Pages with one url follow
    each other by id and are neighbours like any others; exact copies of a page tell it nothing. Malformed markup never
    fails. A very long page is taken whole. No rows in: no rows out. Other columns are not read.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    own = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"), path.alias("path"),
        F.concat_ws("\x01", host, path, url, F.lpad(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 20, "0")).alias("key"))

    def stated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            state = [hashlib.md5("\n".join(t for t, _ in lines(x)).encode("utf-8", "surrogatepass")).hexdigest() for x in batch["html"]]
            yield pd.DataFrame({"k": batch["key"], "host": batch["host"], "state": state})

    marks = materialize(map_pandas(own.select("key", "host", "html"), stated, "k string, host string, state string"), "html-marks")
    dealt = ordered_runs(own, "key", F.octet_length("html"), marks=marks)
    discard(marks)
    dealt = dealt.sortWithinPartitions("_role", "key", "html")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, held = None, []  # held: rows in order with the very same lines
        for batch in batches:
            out = []
            for row in zip(batch["page_id"], batch["url"], batch["host"], batch["path"], batch["key"], batch["_role"], map(lines, batch["html"]), strict=True):
                if held and alike(held[-1], row):
                    held.append((*row[:6], held[-1][6]) if row[6] == held[-1][6] else row)
                    continue
                out += [x for now in held for x in finished(before, now, row)]
                before, held = held[-1] if held else None, [row]
            if out:
                yield framed(out)
        if out := [x for now in held for x in finished(before, now, None)]:
            yield framed(out)

    return map_pandas(dealt.select("page_id", "url", "html", "host", "path", "key", "_role"), run, f"page_id {kind}, url string, text string, n_chars long")


def alike(a: tuple, b: tuple) -> bool:
    """Whether two rows are of one host and have the very same lines."""
    return a[2] == b[2] and [t for t, _ in a[6]] == [t for t, _ in b[6]]


def finished(before: tuple | None, now: tuple, after: tuple | None) -> list[tuple]:
    """The finished row of a page of this range; nothing for a neighbouring range's."""
    page_id, url, host, path, key, role, own = now
    if role != 0:
        return []
    # around the end of all, the first page comes after the last: it is no neighbour
    near = [x for x in (before, after) if x and x[2] == host and (x is before) == (x[4] <= key)]
    near.sort(key=lambda x: -agreement(x[3], path))
    text = main_text(own, [x[6] for x in near])
    return [(page_id, url, text, len(text))]


def framed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars"])
