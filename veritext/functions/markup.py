"""Kernels for markup that needs a parser: tables with spans, wrappers, canonical HTML."""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser
from itertools import accumulate

from veritext.config import CROSS_PAGE_LOOKBACK
from veritext.functions import rules
from veritext.functions.kernels import flat

# --- HTML tables ---------------------------------------------------------------


class _Cells(HTMLParser):
    """Closed rows of closed cells as (text, rows, columns); what stays open at the end, or is reopened, is lost."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.row, self.cell, self.size = [], None, None, (1, 1)

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            given = dict(attrs)
            self.cell, self.size = [], (_count(given.get("rowspan")), _count(given.get("colspan")))
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            if self.row is not None:
                self.row.append((flat("".join(self.cell)), *self.size))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def _count(value: str | None) -> int:
    """A span attribute; 1 if it's no positive number."""
    try:
        return max(1, int(value))
    except (TypeError, ValueError):
        return 1


def spread(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """The matrix in which each cell's text stands in all places it spans.

    Cells from above take their columns only as the row reaches them, so that a
    column beyond a short row's end waits; rows without any cell are left out, and
    what waits at the end makes rows of its own, blank elsewhere.
    """
    waiting: dict[int, list] = {}
    out: list[list[str]] = []

    def take(column: int) -> str:
        held = waiting[column]
        held[0] -= 1
        if not held[0]:
            del waiting[column]
        return held[1]

    for cells in rows:
        line: list[str] = []
        for text, down, across in [*cells, (None, 0, 0)]:
            while len(line) in waiting:
                line.append(take(len(line)))
            for _ in range(across):
                if down > 1:
                    waiting[len(line)] = [down - 1, text]
                line.append(text)
        if line:
            out.append(line)
    while waiting:
        out.append([take(c) if c in waiting else "" for c in range(max(waiting) + 1)])
    return out


#: Tags that cells are found without, and rows of closed cells: markup that a parser has no doubt about, with no attributes but spans and no references, comments or raw text.
_IGNORED = "</?(?:table|thead|tbody|b|i|strong|em)>"
_SIMPLE = r"""(?:[^<>&]*+<tr>(?:[^<>&]*+<t[dh](?: (?:rowspan|colspan)=(?:"[0-9]++"|[0-9]++))*+>[^<>&]*+</t[dh]>)*+[^<>&]*+</tr>)*+[^<>&]*+"""


def simple_cells(raw: str) -> list[list[tuple[str, int, int]]] | None:
    """What _Cells finds in plain rows of closed cells, in a fraction of the time; None for other markup."""
    bare = rules.compiled(_IGNORED).sub("", raw)
    if not rules.compiled(_SIMPLE).fullmatch(bare):
        return None
    cells, known = rules.compiled("<t[dh]([^>]*)>([^<]*)"), {"": (1, 1)}
    rows = []
    for part in bare.split("</tr>")[:-1]:
        row = []
        for attrs, data in cells.findall(part):
            if (size := known.get(attrs)) is None:
                given = dict(x.split("=") for x in attrs.replace('"', "").split())
                size = known[attrs] = _count(given.get("rowspan")), _count(given.get("colspan"))
            row.append((flat(data), *size))
        rows.append(row)
    return rows


def html_matrix(raw: str) -> list[list[str]]:
    if (rows := simple_cells(raw)) is not None:
        return spread(rows)
    cells = _Cells()
    cells.feed(raw)
    cells.close()
    return spread(cells.rows)


# --- pipe tables ---------------------------------------------------------------


def is_pipe(line: str) -> bool:
    return "|" in line and not line.strip().startswith("```")


def pipe_cells(line: str) -> list[str]:
    body = line.strip()
    body = body[body.startswith("|") :]
    body = body[: -1 if body.endswith("|") else None]
    return [flat(x.replace("\\|", "|")) for x in re.split(r"(?<!\\)\|", body)]


def is_separator(line: str) -> bool:
    return is_pipe(line) and all(re.fullmatch(r":?-{3,}:?", x.replace(" ", "")) for x in pipe_cells(line))


def pipe_matrix(raw: str) -> list[list[str]]:
    return [pipe_cells(x) for x in raw.splitlines() if is_pipe(x) and not is_separator(x)]


def matrix(raw: str) -> list[list[str]]:
    return html_matrix(raw) if rules.compiled(r"<table\b", "i").search(raw) else pipe_matrix(raw)


# --- extraction ----------------------------------------------------------------


def cross_page(text: str, start: int) -> dict | None:
    """The pages of a marker that stands right before a table."""
    near = text[max(0, start - CROSS_PAGE_LOOKBACK) : start]
    last = None
    for last in rules.compiled(rules.CROSS_PAGE, "i").finditer(near):
        pass
    if last is None or near[last.end() :].strip() or int(last[2]) <= int(last[1]):
        return None
    return {"start": int(last[1]), "end": int(last[2])}


def pipe_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where pipe tables stand: a pipe row over a separator, and the pipe rows that follow, outside of what is taken."""
    lines = text.splitlines(keepends=True)
    ends = list(accumulate(map(len, lines)))
    begins = [0, *ends[:-1]]
    starts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        k = bisect_right(starts, b - 1) - 1
        return k < 0 or taken[k][1] <= a

    out, i = [], 0
    while i + 1 < len(lines):
        j = i + 1
        if free(begins[i], ends[j]) and is_pipe(lines[i]) and is_separator(lines[j]):
            while j + 1 < len(lines) and is_pipe(lines[j + 1]) and free(begins[j + 1], ends[j + 1]):
                j += 1
            out.append((begins[i], ends[j]))
            i = j
        i += 1
    return out


def extract(text: str) -> dict:
    """All tables in order, and the text with a line feed in place of each."""
    found = [(m.start(), m.end(), "html") for m in rules.compiled(r"<table\b.*?</table\s*>", "is").finditer(text)]
    found += [(a, b, "pipe") for a, b in pipe_spans(text, [x[:2] for x in found])]
    tables, rest, at = [], [], 0
    for k, (a, b, kind) in enumerate(sorted(found)):
        raw = text[a:b]
        tables.append({"index": k, "kind": kind, "start": a, "end": b, "raw": raw, "matrix": matrix(raw), "span_pages": cross_page(text, a)})
        rest += [text[at:a], "\n"]
        at = b
    return {"tables": tables, "body": "".join(rest) + text[at:]}
