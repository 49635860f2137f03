"""Column functions over Markdown and plain text. Patterns use (?U) wherever word characters or spaces are Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable; else every use inside a lambda repeats it."""
    return F.transform(F.array(value), body)[0]


def _replace(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def _dashes(text: Column) -> Column:
    return F.btrim(text, F.lit("-"))


def slug_header(text: Column) -> Column:
    """Dots become dashes, underscores stay."""
    kept = _replace(F.lower(text), r"(?U)[^\w\s.-]")
    return _dashes(_replace(_replace(kept, r"(?U)[.\s]+", "-"), "-+", "-"))


def slug_split(text: Column) -> Column:
    """Dots go, underscores stay."""
    return _dashes(_replace(_replace(F.lower(text), r"(?U)[^\w\s-]"), r"(?U)[-\s]+", "-"))


def slug_anchor(text: Column) -> Column:
    """Dots go, underscores become dashes: chunk ids, section paths and link anchors."""
    return _dashes(_replace(_replace(F.lower(text), r"(?U)[^\w\s-]"), r"(?U)[-\s_]+", "-"))


def n_tokens(text: Column) -> Column:
    """Four characters a token: the count that needs no vocabulary file."""
    return F.floor(F.length(text) / 4).cast("int")


def trim_tokens(text: Column, most: int) -> Column:
    """Texts above ``most`` tokens keep ``most - 1`` of them less the room of the dots."""
    if most <= 0:
        return F.lit("")
    return F.when(F.length(text) > 4 * most, F.concat(F.substring(text, 1, 4 * most - 3), F.lit("..."))).otherwise(text)


def hash16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_key(model: str, content_hash: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}:"), content_hash), 256)


def count_words(text: Column) -> Column:
    """Words left once code, links, images, header marks and emphasis are stripped, in that order."""
    for pattern, by in (
        (r"```[\s\S]*?```", ""),
        (r"`[^`]+`", ""),
        (r"\[([^\]]*)\]\([^)]+\)", "$1"),
        (r"!\[[^\]]*\]\([^)]+\)", ""),
        (r"(?dm)^#+\s*", ""),
        (r"[*_]{1,2}([^*_]+)[*_]{1,2}", "$1"),
    ):
        text = _replace(text, pattern, by)
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def has_code(text: Column) -> Column:
    return text.rlike(r"```[\s\S]*?```") | text.rlike("`[^`]+`") | text.rlike(r"(?Udm)^ {4}.*\S")


def has_table(text: Column) -> Column:
    return text.rlike(r"\|\s*:?-+:?\s*\|")


def images(text: Column) -> Column:
    """Distinct image targets, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"!\[([^\]]*)\]\(([^)]+)\)"), F.lit(2)))


def link_type(url: Column) -> Column:
    u = F.trim(url)
    markdown = u.endswith(".md") | u.endswith(".markdown") | u.contains(".md#") | u.contains(".markdown#")
    scheme = u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    relative = ~scheme & (u.contains("/") | u.endswith(".html"))
    return F.when(u.startswith("#"), "internal").when(u.rlike("(?i)^https?:"), "external").when(markdown | relative, "cross_doc").otherwise("external")


def links(text: Column) -> Column:
    """Array of (url, type) in reading order: within a line first ``[text](url)``, then ``<url>``."""
    lines = F.split(text, "\n")

    def of_line(line):
        named = F.regexp_extract_all(line, F.lit(r"\[([^\]]*)\]\(([^)]+)\)"), F.lit(2))
        bare = F.regexp_extract_all(line, F.lit(r"<(https?://[^>]+)>"), F.lit(1))
        pair = lambda u, t: F.struct(u.alias("url"), t.alias("type"))
        return F.concat(F.transform(named, lambda u: pair(u, link_type(u))), F.transform(bare, lambda u: pair(u, F.lit("external"))))

    return F.flatten(F.transform(lines, of_line))


def links_of(found: Column, kind: str) -> Column:
    """Distinct urls of one type, in order of first sight."""
    return F.array_distinct(F.transform(F.filter(found, lambda x: x["type"] == kind), lambda x: x["url"]))


def all_links(found: Column) -> Column:
    """Distinct urls: links to other documents first, then external ones, then anchors."""
    return F.array_distinct(F.concat(links_of(found, "cross_doc"), links_of(found, "external"), links_of(found, "internal")))


def resolve_path(source: Column, ref: Column) -> Column:
    """``ref`` as seen from the directory of ``source``, normalised against the corpus root."""
    parts = F.concat(F.slice(F.split(source, "/"), 1, F.greatest(F.size(F.split(source, "/")) - 1, F.lit(0))), F.split(ref, "/"))
    start = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, start, step), "/")


def link_target(url: Column, source: Column) -> Column:
    """Chunk id that a link to another document means; null where it means none."""
    cut = F.split(url, "#", 2)
    file, anchor = cut[0], F.get(cut, F.lit(1))
    here = F.when(file == "", source).otherwise(resolve_path(source, file))
    whole = F.when(url.endswith(".md") | url.endswith(".markdown"), F.concat(resolve_path(source, url), F.lit(":document")))
    return F.when(anchor.isNotNull(), F.concat(here, F.lit(":"), slug_anchor(anchor))).otherwise(whole)


def parent_dir(path: Column) -> Column:
    """Name of the directory that holds the file, '' at the root."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.when(F.size(F.split(path, "/")) > 1, -2).otherwise(F.lit(None).cast("int"))), F.lit(""))


def tidy(text: Column) -> Column:
    """Lines without trailing blanks, blank runs as one empty line, ends stripped."""
    out = _replace(text, r"(?Udm)[^\S\n]+$")
    out = _replace(out, r"\n{3,}", "\n\n")
    return _replace(out, r"(?U)^\s+|\s+$")


def version_at_least(version: Column, least: str) -> Column:
    """Compare dotted numbers part by part, missing parts as 0; anything else is not supported."""
    want = [int(x) for x in least.split(".")]
    have = F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))
    size = F.greatest(F.size(have), F.lit(len(want)))
    pad = lambda a: F.slice(F.concat(a, F.array_repeat(F.lit(0), size)), F.lit(1), size)
    ok = ~F.exists(have, lambda x: x.isNull())
    return F.coalesce(ok & (pad(have) >= pad(F.array(*[F.lit(w) for w in want]))), F.lit(False))


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
