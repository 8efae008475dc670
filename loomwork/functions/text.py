"""Text as columns: normal forms, tokens, windows, citations, identifiers, HTML. Null in, null out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACE = r"[\s\x{A0}]+"


def normalized(text: Column) -> Column:
    """Lower-case words of a-z and 0-9, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Distinct words of a-z and 0-9, in order of first occurrence; null: none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0))


def cell(text: Column) -> Column:
    """A spreadsheet cell as text: null is empty, white space collapses, an integral number loses its .0."""
    flat = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"\s+", " "))
    return F.regexp_replace(flat, r"^(-?\d+)\.0$", "$1")


def question_id(text: Column) -> Column:
    """An id without the .0 that spreadsheets add."""
    return F.regexp_replace(F.trim(text.cast("string")), r"^(\d+)\.0$", "$1")


def answer_words(text: Column) -> Column:
    """Words for comparing answers: lower case, without punctuation and articles; null: none."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(*fixed.ARTICLES))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def document_text(text: Column) -> Column:
    """Lines with collapsed white space, blank ones dropped, entities resolved."""
    lines = F.transform(F.split(unescaped(F.regexp_replace(text, "\r\n?", "\n")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def answer_text(text: Column) -> Column:
    """Blocks of lines: white space in a line collapses, blank lines separate blocks once."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def unescaped(text: Column) -> Column:
    """The common HTML entities as characters, & last."""
    pairs = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def preview(text: Column, most: int = 220) -> Column:
    """One line of at most so many characters, ... included only if it was cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("...")))


def logged_list(text: Column) -> Column:
    """Distinct items between newlines, commas and semicolons; null: none."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n,;]+"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def windows(text: Column, size: int = 1200, overlap: int = 150) -> Column:
    """array<struct(chunk_index, chunk)>: windows of size characters, each beginning overlap before the last one's end, trimmed, blank ones dropped.

    The last window is the first that reaches the end. Null and empty: none.
    """
    if size <= 0 or overlap < 0:
        raise ValueError("size must be above 0 and overlap not below")
    stride = max(size - overlap, 1)
    n = F.length(text)
    last = F.greatest(F.ceil((n - size) / stride), F.lit(0)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda i: F.trim(F.regexp_replace(F.substring(text, i * stride + 1, F.lit(size)), r"^\s+|\s+$", "")))
    parts = F.filter(parts, lambda x: x != "")
    return F.transform(parts, lambda x, i: F.struct(i.alias("chunk_index"), x.alias("chunk")))


#: The namespace of URLs for name-based identifiers (a public constant), as hex.
_URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The name-based identifier (version 5) of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_SPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def chunk_id(seed: Column) -> Column:
    return uuid5(F.sha1(F.encode(seed, "UTF-8")))


def _all(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), group)
    clean = lambda t: F.btrim(F.btrim(F.trim(t), F.lit("[](){}")), F.lit(" ,.;:"))
    return F.transform(found, clean)


def doc_citations(text: Column) -> Column:
    """Distinct ids cited as documents, by pattern and then by place."""
    return F.array_distinct(F.concat(*[_all(text, p, 1) for p in fixed.DOC_CITATIONS]))


def web_citations(text: Column) -> Column:
    """Distinct ids, addresses and numbered sources cited from the web."""
    sources = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.SOURCE), 1), lambda n: F.concat(F.lit("source_"), n))
    return F.array_distinct(F.concat(*[_all(text, p, 1) for p in fixed.WEB_CITATIONS], _all(text, fixed.URL, 0), sources))


def evidence_citations(text: Column, most: Column) -> Column:
    """Distinct n of [E n] with 1 <= n <= most."""
    n = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[E\s*(\d{1,6})\]"), 1), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(n, lambda x: (x >= 1) & (x <= most)))


def citation_coverage(text: Column, chunks: Column) -> Column:
    """Cited evidence numbers by retrieved chunks; null without chunks."""
    return F.when(chunks > 0, F.size(evidence_citations(text, chunks)) / chunks)


def retrieved_citations(text: Column, ids: Column) -> Column:
    """Retrieved ids that the answer cites in brackets, sorted; else those named on a line that begins with Evidence:."""
    cited = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[((?:DOC|WEB):[^\]]+)\]"), 1), lambda x: F.trim(x))
    direct = F.array_sort(F.array_intersect(cited, ids))
    lines = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.lower(F.trim(x)).startswith("evidence:")), "\n")
    return F.when(F.size(direct) > 0, direct).otherwise(F.array_sort(F.array_distinct(F.filter(ids, lambda i: F.contains(lines, i)))))


def abstained(text: Column) -> Column:
    return F.coalesce(text.rlike(fixed.ABSTAINED), F.lit(False))


def abstained_marker(text: Column) -> Column:
    """The narrower sense: the answer begins by declaring insufficient evidence."""
    return F.coalesce(F.contains(F.lower(text), F.lit("insufficient evidence:")), F.lit(False))


def contains_any(text: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """Whether text holds one of the terms; null: no."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms], F.lit(False)), F.lit(False))


def first_match(text: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches with something in it."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


_META = r"""(?is)<meta[^>]*(?:property|name)\s*=\s*["']{0}["'][^>]*content\s*=\s*["']([^"']*)["']"""


def html_title(html: Column) -> Column:
    """og:title, else twitter:title, else <title>."""
    return unescaped(first_match(html, _META.format("og:title"), _META.format("twitter:title"), r"(?is)<title[^>]*>(.*?)</title>"))


def html_url(html: Column) -> Column:
    """The canonical link, else og:url."""
    return first_match(html, r"""(?is)<link[^>]*rel\s*=\s*["']canonical["'][^>]*href\s*=\s*["']([^"']*)["']""", _META.format("og:url"))


def html_text(html: Column) -> Column:
    """The text of article, main or body without scripts, styles, media and page furniture, one line per run of text."""
    bare = html
    for tag in ("script", "style", "noscript", "svg", "picture", "header", "footer", "nav", "aside", "form"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    root = F.coalesce(first_match(bare, r"(?is)<article\b[^>]*>(.*)</article>"), first_match(bare, r"(?is)<main\b[^>]*>(.*)</main>"), first_match(bare, r"(?is)<body\b[^>]*>(.*)</body>"), bare)
    return document_text(F.regexp_replace(root, r"(?s)<!--.*?-->|<[^>]*>", "\n"))
