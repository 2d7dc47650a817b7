"""Text scalars as native Column expressions (no Python worker), and Arrow UDFs where Unicode normal forms need them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The rules' word lists, limits and classes.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "has", "have", "how", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to",
    "was", "what", "when", "where", "which", "who", "why", "with", "we", "you", "our", "about",
    "o", "os", "e", "de", "da", "do", "das", "dos", "em", "no", "na", "nos", "nas", "um", "uma", "uns", "umas", "para", "por", "com", "que", "se", "ao", "aos", "sua", "seu", "suas", "seus",
    "ou", "mais", "como", "foi", "era",
)
TITLE_WORDS = ("mestre", "mestra", "contramestre", "contramestra", "contra-mestre", "contra-mestra", "professor", "professora")
DASHES = "­‐‑‒–—―−﹣－"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f​-‏‪-‮⁦-⁩﻿  \x{E0020}-\x{E007F}]"
NAME_PREFIXES = ("system:", "assistant:", "ignore", "<|", "[inst]")
NAME_LENGTH = 200
FILE_SUFFIXES = (".md", ".markdown", ".json", ".yaml", ".yml", ".toml", ".txt", ".csv", ".sql", ".py", ".ts", ".tsx", ".html", ".pdf")
SECRET_PARTS = (
    "token", "key", "secret", "password", "passwd", "pwd", "pass", "sig", "signature", "auth", "authorization", "credential", "credentials", "jwt", "apikey", "accesstoken", "clientsecret",
)
LINK_TARGET = r'\((?:<[^>]*>|(?:[^()\s]|\([^()\s]*\))*)(?:\s+"[^"]*")?\)'
LABEL_LENGTH = 60


def fold_text(text: str) -> str:
    """Compatibility decomposition without combining marks, case folded."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def _latin() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters of the Latin blocks that fold to one character, what they fold to, and those that fold to several."""
    single, many = {}, []
    for code in (*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        c = chr(code)
        folded = fold_text(c)
        if len(folded) == 1 and folded != c:
            single[c] = folded
        elif len(folded) > 1:
            many.append((c, folded))
    return "".join(single), "".join(single.values()), many


_ONE, _TO, _MANY = _latin()


def fold(text: Column) -> Column:
    """Accent- and case-insensitive form, in the JVM: exact for Latin letters; other scripts are lower-cased and lose combining marks."""
    out = F.translate(F.lower(text), _ONE, _TO)
    for c, folded in _MANY:
        if c.lower() == c and c in "ßŉǰĳŀﬁﬂ":
            out = F.replace(out, F.lit(c), F.lit(folded))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.regexp_replace(out, r"\p{M}+", ""))


@F.pandas_udf(T.StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """The same for all scripts, by an Arrow UDF."""
    return text.map(lambda x: None if x is None else fold_text(x))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def tokens(text: Column, folded: bool = False) -> Column:
    """Folded word runs, joined ones (by - _ . ') whole and in parts, without stop words."""
    base = text if folded else fold(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(base, F.lit(r"[a-z0-9]+(?:[-_.'][a-z0-9]+)*"), F.lit(0))
    pieces = F.flatten(F.transform(found, lambda t: F.when(t.rlike(r"[-_.']"), F.concat(F.array(t), F.split(t, r"[-_.']"))).otherwise(F.array(t))))
    return F.filter(pieces, lambda t: ~t.isin(*STOPWORDS))


def norm(text: Column) -> Column:
    """Folded, runs of other characters than a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


#: The balanced group a name ends with, nested up to three deep.
_GROUP = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)$"


def _tail(name: Column) -> Column:
    """The place (from 0) of the bracket that opens the balanced group a name ends with; -1 if there is none. Only groups nested deeper than _GROUP are walked by character."""
    text = F.regexp_replace(name, r"(?U)\s+$", "")
    chars = F.reverse(F.split(text, ""))
    walked = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(-1).alias("at")),
        lambda s, c: F.struct(
            (s["depth"] + F.when(c == ")", 1).when(c == "(", -1).otherwise(0)).cast("int").alias("depth"),
            (s["n"] + 1).cast("int").alias("n"),
            F.when((s["at"] < 0) & (c == "(") & (s["depth"] == 1), s["n"]).otherwise(s["at"]).cast("int").alias("at"),
        ),
    )
    group = F.regexp_extract(text, _GROUP, 0)
    return F.when(~text.endswith(")"), F.lit(-1)).when(group != "", F.length(text) - F.length(group)).when(walked["at"] >= 0, F.length(text) - 1 - walked["at"]).otherwise(F.lit(-1))


def split_qualifier(name: Column) -> tuple[Column, Column]:
    """(base, qualifier): the name without and the text inside its last balanced group in brackets; the whole name and '' without one."""
    text, at = F.regexp_replace(name, r"(?U)\s+$", ""), _tail(name)
    base = F.regexp_replace(F.substring(text, F.lit(1), at), r"(?U)^\s+|\s+$", "")
    inner = F.regexp_replace(F.substring(text, at + 2, F.length(text) - at - 2), r"(?U)^\s+|\s+$", "")
    has = (at >= 0) & (base != "")
    return F.when(has, base).otherwise(name), F.when(has, inner).otherwise(F.lit(""))


def strip_title(normed: Column, titles: tuple[str, ...] = TITLE_WORDS) -> Column:
    """A normalised name without one leading title word; a title alone stays."""
    words = sorted({" ".join("".join(c if c.isalnum() else " " for c in fold_text(t)).split()) for t in titles}, key=lambda t: (-len(t), t))
    return F.regexp_replace(normed, "^(?:" + "|".join(words) + ") (?=.)", "") if words else normed


def split_name(name: Column) -> tuple[Column, Column]:
    """(base, bracket) of a name, both normalised; a name that is only a bracket keeps its whole text as base."""
    text, at = F.regexp_replace(name, r"(?U)\s+$", ""), _tail(name)
    inside = F.when(at >= 0, norm(F.substring(text, at + 2, F.length(text) - at - 2))).otherwise(F.lit(""))
    base = F.when(at >= 0, norm(F.substring(text, F.lit(1), at))).otherwise(F.lit(""))
    return F.when(base != "", base).otherwise(norm(name)), inside


def name_key(name: Column, titles: tuple[str, ...] = TITLE_WORDS) -> Column:
    return strip_title(split_name(name)[0], titles)


def name_keys(name: Column, titles: tuple[str, ...] = TITLE_WORDS) -> Column:
    """The keys a name answers to: its base and its bracket, titles stripped, without empty ones."""
    base, inside = split_name(name)
    return F.array_distinct(F.filter(F.array(strip_title(base, titles), strip_title(inside, titles)), lambda k: k != ""))


def normalize_title(raw: Column) -> Column:
    """Key of a title: composed form given, dashes as hyphens, lower case, single spaces. Pass nfc(raw) where text may be decomposed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(raw, DASHES, "-" * len(DASHES))), r"(?U)\s+", " "), r"^ | $", "")


@F.pandas_udf(T.StringType())
def title_exact(raw: pd.Series) -> pd.Series:
    """normalize_title for all scripts: composed form, dashes as hyphens, case folded, single spaces."""
    dashes = str.maketrans(DASHES, "-" * len(DASHES))
    return raw.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).translate(dashes).casefold().split()))


def endpoint_key(name: Column) -> Column:
    """The key a relation's end is found by: that of the name made safe, else of the name as it is."""
    return normalize_title(F.coalesce(sanitize_name(name), name))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(name), r"(?U)[\W_]+", "-"), "^-|-$", "")


def same_subject(a: Column, b: Column) -> Column:
    return (normalize_title(a) == normalize_title(b)) | ((slug(a) != "") & (slug(a) == slug(b)))


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def sanitize_name(name: Column) -> Column:
    """The trimmed name without control characters; null if it starts like a prompt, is blank or too long."""
    clean = F.regexp_replace(strip_controls(name), r"(?U)^\s+|\s+$", "")
    bad = F.lit(False)
    for p in NAME_PREFIXES:
        bad |= F.lower(clean).startswith(p)
    return F.when(~bad & (clean != "") & (F.length(clean) <= NAME_LENGTH), clean)


def identifier_like(name: Column) -> Column:
    """Whether a name is a snake or kebab label, an address or a file name rather than a name."""
    text = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    label = text.rlike(r"^[A-Za-z0-9]+(_[A-Za-z0-9]+)+$") | text.rlike(r"^[a-z0-9]+(-[a-z0-9]+){2,}$")
    address = text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") | F.lower(text).startswith("www.") | text.rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+/")
    file = F.lit(False)
    for s in FILE_SUFFIXES:
        file |= F.lower(F.element_at(F.split(text, "/"), -1)).endswith(s)
    return F.coalesce((text != "") & (label | (~text.rlike(r"(?U)\s") & (address | file))), F.lit(False))


def fact_key(unit: Column) -> Column:
    """Key of a fact unit: tags and trailing page marks gone, no leading dash, lower case, single spaces, no .;, at the end."""
    text = F.regexp_replace(unit, r"(?i)\[(?:also|superseded):[^\]]*\]", "")
    text = F.regexp_replace(text, r"(?U)(\s*\[pp?\. [^\]]*\]\s*)+$", "")
    text = F.lower(F.regexp_replace(text, r"(?U)^\s*-\s+", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")
    return F.trim(F.regexp_replace(text, "[.;,]+$", ""))


def fact_key_exact(unit: Column) -> Column:
    """The same key of the unit's compatibility form, by an Arrow UDF."""
    return fact_key(nfkc(unit))


def visible_text(markdown: Column) -> Column:
    """What a reader sees: labels of images and links, no addresses, no markup, single spaces."""
    text = F.regexp_replace(F.coalesce(markdown, F.lit("")), r"!\[([^\]]*)\]" + LINK_TARGET, "$1")
    text = F.regexp_replace(text, r"\[([^\]]*)\]" + LINK_TARGET, "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"<?https?://\S+>?", " "), r"[#*_>`|~=\[\]-]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def scrub_credentials(url: Column) -> Column:
    """An address without user, query and fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), r"[?#].*$", "")
    return F.when(bare.contains("://"), F.regexp_replace(bare, r"^([^:/]+://)[^/]*@", "$1")).otherwise(F.regexp_replace(bare, r"^[^/]*@", ""))


def scrub_text_urls(text: Column) -> Column:
    """Prose whose http addresses have no user, query and fragment."""
    found = r"""(?i)(https?://)(?:[^\s)\]>"'/?#]*@)?([^\s)\]>"'?#]*)(?:[?#][^\s)\]>"']*)?"""
    return F.regexp_replace(F.coalesce(text, F.lit("")), found, "$1$2")


def secret_param(name: Column) -> Column:
    """Whether a query parameter's name, or a part of it, names a secret."""
    plain = F.coalesce(F.try_url_decode(name), name)
    parts = F.regexp_extract_all(plain, F.lit(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])"), F.lit(0))
    return F.lower(plain).isin(*SECRET_PARTS) | F.exists(parts, lambda p: F.lower(p).isin(*SECRET_PARTS))


def scrub_url_secrets(url: Column) -> Column:
    """An address without user and secret parameters; all else stays byte by byte."""
    bare = F.when(url.contains("://"), F.regexp_replace(url, r"^([^:/]+://)[^/?#]*@", "$1")).otherwise(F.regexp_replace(url, r"^[^/?#]*@", ""))
    query = F.regexp_extract(bare, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~secret_param(F.regexp_extract(p, "^([^=]*)", 1)))
    head, tail = F.regexp_extract(bare, r"^([^?#]*)", 1), F.regexp_extract(bare, r"(#.*)$", 1)
    joined = F.array_join(kept, "&")
    changed = F.concat(head, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")), tail)
    return F.when((query != "") & (F.size(kept) < F.size(F.split(query, "&"))), changed).otherwise(bare)


def elide_path(url: Column, least: int = 20) -> Column:
    """An address whose path segments of `least` characters or more are an ellipsis."""
    return F.when(url.contains("://"), F.concat(F.regexp_extract(url, r"^([^:]*://[^/]*)", 1), F.regexp_replace(F.regexp_extract(url, r"^[^:]*://[^/]*(/.*)?$", 1), rf"[^/]{{{least},}}", "…"))).otherwise(url)


def normalize_breaks(text: Column) -> Column:
    """All line breaks as newlines, without control and format characters."""
    return F.regexp_replace(strip_controls(F.regexp_replace(text, r"\r\n|[\r\u0085  ]", "\n")), r"\p{Cf}", "")


def defuse(text: Column) -> Column:
    """New text that cannot pass for tags, headings or ids: line by line."""
    def line(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"(?i)\[(?=(?:also:|superseded:|conflict))", "("), r"^[\s#>\-]+", "")
        return F.trim(F.replace(F.regexp_replace(x, "#{2,}", "#"), F.lit("(id:"), F.lit("(id :")))

    return F.array_join(F.transform(F.split(normalize_breaks(text), "\n"), line), "\n")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def garbled_share(text: Column) -> Column:
    """Share of private, unassigned, surrogate, control and replacement characters among those that are no white space."""
    solid = F.regexp_replace(text, r"(?U)\s+", "")
    return F.when(F.length(solid) > 0, F.length(F.regexp_replace(solid, r"[^\p{Co}\p{Cn}\p{Cs}\p{Cc}�]", "")) / F.length(solid)).otherwise(F.lit(0.0))


def edge_label(raw: Column) -> Column:
    """A relation's label: lower case, spaces for underscores, one line, LABEL_LENGTH characters; `related` if nothing is left."""
    text = F.regexp_replace(strip_controls(F.replace(F.coalesce(raw, F.lit("")), F.lit("_"), F.lit(" "))), r"(?U)\s+", " ")
    text = F.translate(F.lower(text), "[];", "(),")
    text = F.regexp_replace(F.replace(text, F.lit("->"), F.lit("to")), r"(?U)^[\s\p{P}]+|[\s\p{P}]+$", "")
    cut = F.regexp_replace(F.substring(text, 1, LABEL_LENGTH), r"(?U)\s+$", "")
    return F.when(cut != "", cut).otherwise(F.lit("related"))


def version(text: Column) -> Column:
    """A dotted version as an array of at least three numbers, other parts 0; arrays compare in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return F.concat(parts, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(3) - F.size(parts))))


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """The version 5 UUID of a name (default name space: URLs)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.lpad(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))), 2, "0"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def looks_like_html(text: Column) -> Column:
    start = F.lower(F.substring(F.regexp_replace(text, r"(?U)^\s+", ""), 1, 256))
    return start.contains("<!doctype html") | start.contains("<html")


def text_verdict(raw: Column, markdown: Column, least: int = 300, challenge: int = 2000, seen: Column | None = None) -> Column:
    """Why a page has no usable content, or null: empty, challenge_page, too_little_text. js_shell needs a parser: sources.html.

    It asks for the visible length several times; `seen`, a column that holds it, saves working it out each time.
    """
    seen, low = F.length(visible_text(markdown)) if seen is None else seen, F.lower(raw)
    html = looks_like_html(raw) | low.contains("<body") | low.contains("<div")
    # Marks of challenge pages and of captcha widgets.
    wall = low.contains("cf-chl") | low.contains("just a moment...") | low.contains("checking your browser") | low.contains("attention required")
    captcha = low.contains("g-recaptcha") | low.contains("h-captcha") | low.contains("cf-turnstile")
    return (
        F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "empty")
        .when(html & (((seen < challenge) & wall) | ((seen < least) & captcha)), "challenge_page")
        .when(seen == 0, "empty")
        .when(seen < least, F.concat(F.lit("too_little_text ("), seen.cast("string"), F.lit(" chars)")))
    )


def navigation_like(line: Column, share: float = 0.5) -> Column:
    """Whether a line of markdown has no visible text, or labels of links as at least this share of it."""
    plain = F.regexp_replace(F.coalesce(line, F.lit("")), r"!\[([^\]]*)\]" + LINK_TARGET, "$1")
    labels = F.regexp_extract_all(plain, F.lit(r"\[([^\]]*)\]" + LINK_TARGET), F.lit(1))
    linked = F.aggregate(labels, F.lit(0), lambda n, x: n + F.length(visible_text(x)))
    seen = F.length(visible_text(line))
    return (seen == 0) | (linked >= share * seen)


def http_url(text: Column) -> Column:
    """Whether a text is one token with the scheme http or https."""
    return F.coalesce(text.rlike(r"^(?i:https?):(?U:\S)*$"), F.lit(False))


def one_line(text: Column, most: int) -> Column:
    """A label or reason: one line, no brackets, semicolons, forged ids or runs of hashes, `most` characters."""
    flat = F.trim(F.regexp_replace(normalize_breaks(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))
    flat = F.replace(F.translate(flat, "[];", "(),"), F.lit("(id:"), F.lit("(id :"))
    return F.trim(F.substring(F.regexp_replace(flat, "#{2,}", "#"), 1, most))


def section_label(source: Column) -> Column:
    """The label of a source's section: an address without secrets and long path segments, a local path's last part, other text with its addresses scrubbed."""
    text = F.regexp_replace(F.coalesce(source, F.lit("")), r"(?U)^\s+|\s+$", "")
    local = text.rlike(r"^(/|~/|\./|\.\./)") & ~text.contains("\n")
    base = F.regexp_extract(F.regexp_replace(text, "/+$", ""), "([^/]*)$", 1)
    plain = strip_controls(scrub_text_urls(text))
    made = F.when(http_url(text), elide_path(scrub_credentials(text))).when(local, F.when(base != "", base).otherwise(text)).otherwise(plain)
    return F.trim(F.regexp_replace(one_line(made, NAME_LENGTH), "^#+", ""))


def summary_cut(text: Column, most: int = 4000) -> Column:
    """A summary to be kept: controls and secrets out, whole lines up to `most` characters, one longer line cut; null if blank."""
    clean = F.regexp_replace(strip_controls(scrub_text_urls(text)), r"(?U)^\s+|\s+$", "")
    head = F.substring(clean, 1, most)
    lines = F.regexp_extract(head, r"(?s)^(.+)\n[^\n]*$", 1)
    whole = F.substring(clean, most + 1, 1) == "\n"
    cut = F.when(F.length(clean) <= most, clean).when(whole | (lines == ""), head).otherwise(lines)
    return F.nullif(F.regexp_replace(cut, r"(?U)\s+$", ""), F.lit(""))


def title_cut(name: Column) -> Column:
    return F.substring(strip_controls(F.coalesce(name, F.lit(""))), 1, NAME_LENGTH)


def link_name(from_id: Column, to_id: Column) -> Column:
    """The name of a link object: the last eight characters of both ids, no names."""
    return F.concat(F.lit("link "), F.right(from_id, F.lit(8)), F.lit("-"), F.right(to_id, F.lit(8)))


def deep_link(scheme: str, space_id: Column, object_id: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://object/"), space_id, F.lit("/"), object_id)


def short_type(type_key: Column, prefix: str = "wiki_") -> Column:
    """A type's short label: its key without the prefix."""
    return F.replace(F.coalesce(type_key, F.lit("")), F.lit(prefix), F.lit(""))


def fence_safe(text: Column, fences: tuple[str, ...]) -> Column:
    """text that cannot close one of the tags it is fenced by: their `</` becomes `<\\/`."""
    names = "|".join(sorted((f.lower() for f in fences), key=lambda f: (-len(f), f)))
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)</(?=\s*(?:{names})\s*>)", "<\\\\/")


def filled(template: str, values: dict[str, Column], fences: tuple[str, ...]) -> Column:
    """A template with its placeholders (whole keys of values) filled in one pass, so that what looks like a placeholder in a value stays; values are fence-safe."""
    parts = re.split("(" + "|".join(re.escape(k) for k in sorted(values, key=len, reverse=True)) + ")", template) if values else [template]
    return F.concat(*[fence_safe(values[p], fences) if p in values else F.lit(p) for p in parts])
