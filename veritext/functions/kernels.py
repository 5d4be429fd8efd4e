"""Text normal forms as plain functions of strings, for Python workers."""

from __future__ import annotations

import html
import re
import unicodedata

from veritext.config import ScoringConfig
from veritext.functions import rules

#: Without any of these a text is flat: what is not ASCII, begins markup or an entity, emphasizes, or is more than a single space within.
_NOT_FLAT = re.compile(r"[^ -~]|[<&*_`~\[]|  |^ | \Z")


def flat(text: str) -> str:
    """One line of plain text: no entities, comments, markup or runs of white space."""
    if not _NOT_FLAT.search(text):
        return text
    return rules.apply(rules.FLAT, html.unescape(text))


def footnotes(text: str, config: ScoringConfig) -> str:
    return rules.apply(rules.FOOTNOTES, text) if config.normalize_footnotes else text


def merge_markers(text: str) -> str:
    """One image marker for each run of them; blank lines that follow a marker go."""
    out, after = [], False
    for line in rules.MARKERS.python(text).split("\n"):
        body = line.strip()
        if body == "![]":
            out += [] if after else ["![]"]
            after = True
        elif body or not after:
            out.append(line)
            after = False
    return rules.MARKERS.python("\n".join(out))


def images(text: str, config: ScoringConfig) -> str:
    return merge_markers(rules.apply(rules.IMAGES, text)) if config.normalize_images else text


def to_fixpoint(pattern: re.Pattern, replace, text: str) -> str:
    """Substitutes until nothing changes, so that nested wrappers go as well."""
    while (after := pattern.sub(replace, text)) != text:
        text = after
    return text


def details(text: str, config: ScoringConfig) -> str:
    """Wrappers go; what only shows an image becomes a marker."""

    def inner(m: re.Match) -> str:
        kind = re.sub(r"\s+", "_", html.unescape(m[1]).strip().lower()).replace("-", "_")
        body = m[2].strip()
        if config.normalize_images and (kind in rules.VISUAL_KINDS or rules.compiled(rules.MERMAID, "im").search(body)):
            return "\n![]\n"
        return "\n" if kind == "natural_image" else f"\n{body}\n"

    return to_fixpoint(rules.compiled(rules.DETAILS, "is"), inner, text)


def structured(text: str, config: ScoringConfig) -> str:
    """Plain text that keeps its line feeds."""
    text = footnotes(rules.apply(rules.NEWLINES, html.unescape(text)), config)
    text = images(rules.COMMENT.python(details(text, config)), config)
    text = images(rules.apply(rules.LINES_LEFT, text), config)
    return merge_markers(rules.apply(rules.LINES_TIDY, text)).strip(" \t\n")


def variants(text: str, config: ScoringConfig) -> str:
    """Traditional characters by the config's map; without one the text stays, as it does where no converter is installed."""
    return text.translate({ord(a): b for a, b in config.variants}) if config.normalize_zh == "t2s" and config.variants else text


def semantic(text: str, config: ScoringConfig) -> str:
    """structured(), with compatibility characters, variants and punctuation folded."""
    text = footnotes(variants(unicodedata.normalize("NFKC", structured(text, config)), config), config)
    if config.normalize_punctuation:
        text = rules.apply(rules.PUNCTUATION, text.translate(str.maketrans(*rules.FOLDED)))
    return text


def nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)
