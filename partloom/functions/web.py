"""Expressions over crawled pages, source URLs and model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom.functions.text import let, lookup, rewrite, squish, strip
from partloom.vocab import DEFAULT, Vocabulary

# FIXED VALUES: elements without technical content, host and address rules.
DROPPED_ELEMENTS = [
    "script", "style", "nav", "footer", "header", "iframe", "object", "embed", "noscript",
]
LOCAL_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1", "0.0.0.0.0.0.0.0"]
IP_LITERAL = r"^\d{1,3}(\.\d{1,3}){3}$"
RESERVED_IP = (
    r"^(0\.|10\.|127\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|192\.0\.[02]\.|192\.168\."
    r"|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2(2[4-9]|3\d|4\d|5[0-5])\.)"
)
#: Code points of a, e, i, o, u and A, E, I, O, U with each accent.
_ACCENTED = {
    "grave": [224, 232, 236, 242, 249, 192, 200, 204, 210, 217],
    "acute": [225, 233, 237, 243, 250, 193, 201, 205, 211, 218],
    "circ": [226, 234, 238, 244, 251, 194, 202, 206, 212, 219],
    "uml": [228, 235, 239, 246, 252, 196, 203, 207, 214, 220],
}
#: Named character references of catalog pages.
ENTITIES = {
    "&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&reg;": "®", "&trade;": "™", "&copy;": "©",
    "&deg;": "°", "&plusmn;": "±", "&micro;": "µ", "&Omega;": "Ω", "&frac12;": "½", "&frac14;": "¼", "&frac34;": "¾",
    "&frac18;": "⅛", "&frac38;": "⅜", "&frac58;": "⅝", "&frac78;": "⅞", "&times;": "×", "&divide;": "÷",
    "&sup1;": "¹", "&sup2;": "²", "&sup3;": "³", "&prime;": "′", "&Prime;": "″", "&ndash;": "–", "&mdash;": "—",
    "&lsquo;": "‘", "&rsquo;": "’", "&sbquo;": "‚", "&ldquo;": "“", "&rdquo;": "”", "&bdquo;": "„", "&laquo;": "«",
    "&raquo;": "»", "&bull;": "•", "&middot;": "·", "&hellip;": "…", "&le;": "≤", "&ge;": "≥", "&ne;": "≠", "&asymp;": "≈",
    "&empty;": "∅", "&Oslash;": "Ø", "&oslash;": "ø", "&euro;": "€", "&pound;": "£", "&yen;": "¥", "&cent;": "¢",
    "&sect;": "§", "&para;": "¶", "&iexcl;": "¡", "&iquest;": "¿", "&szlig;": "ß", "&ccedil;": "ç", "&Ccedil;": "Ç",
    "&ntilde;": "ñ", "&Ntilde;": "Ñ", "&aring;": "å", "&Aring;": "Å", "&aelig;": "æ", "&AElig;": "Æ",
    **{f"&{letter}{mark};": chr(code) for mark, codes in _ACCENTED.items() for letter, code in zip("aeiouAEIOU", codes)},
    "&amp;": "&",
}
# FIXED VALUES: active content that an uploaded catalog must not carry.
UPLOAD_EXTENSIONS = [".csv", ".xlsx"]
DANGEROUS_CONTENT = ["<script", "javascript:", "vbscript:", "=cmd|", "=exec|", "+cmd|", "-cmd|"]


ENTITY = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z]+[0-9]*);"
_RAW = [e for e in DROPPED_ELEMENTS if e in ("script", "style", "iframe")]
_NESTING = [e for e in DROPPED_ELEMENTS if e not in (*_RAW, "embed")]


def _numeric(e: Column) -> Column:
    """A numeric character reference by rule; one that names no character becomes U+FFFD."""
    digits = F.regexp_extract(e, "([0-9a-fA-F]+);", 1)
    base = F.when(F.lower(e).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits)
    n = F.when(F.length(base) < 10, base.cast("bigint")).otherwise(-1)
    sound = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")).otherwise("\ufffd")


def decoded(text: Column) -> Column:
    """Character references decoded in one pass, so nothing is decoded twice; names that are not known stay."""

    def char(e: Column) -> Column:
        return F.when(e.startswith("&#"), _numeric(e)).otherwise(F.coalesce(lookup(ENTITIES, e), e))

    return rewrite(text, ENTITY, char)


def _without_nested(text: Column) -> Column:
    """``text`` without the elements of ``_NESTING``, each up to the end tag that belongs to it, or to the end of the page.

    One fold over the tags of these elements, which are few, with a counter of those of the same name that are open.
    """
    tag = rf"(?i)</?(?:{'|'.join(_NESTING)})\b[^>]*>"
    pieces = lambda t: F.zip_with(
        F.split(t, tag, -1), F.regexp_extract_all(t, F.lit(tag), F.lit(0)),
        lambda gap, hit: F.struct(gap.alias("gap"), F.lower(F.regexp_extract(hit, "</?([A-Za-z]+)", 1)).alias("name"), F.startswith(hit, F.lit("</")).alias("ends")),
    )
    start = F.struct(F.lit("").alias("kept"), F.lit("").alias("within"), F.lit(0).alias("open"))

    def step(state: Column, piece: Column) -> Column:
        outside = state["within"] == ""
        same = piece["name"] == state["within"]
        opens = F.when(outside & ~piece["ends"], 1).when(~outside & same, state["open"] + F.when(piece["ends"], -1).otherwise(1)).otherwise(state["open"])
        opens = F.coalesce(opens, F.lit(0))
        name = F.when(opens == 0, "").when(outside, piece["name"]).otherwise(state["within"])
        kept = F.when(outside, F.concat(state["kept"], F.lit(" "), piece["gap"])).otherwise(state["kept"])
        return F.struct(kept.alias("kept"), name.alias("within"), opens.alias("open"))

    return let(text, lambda t: F.when(t.rlike(tag), F.aggregate(pieces(t), start, step)["kept"]).otherwise(t))


def technical_text(html: Column) -> Column:
    """Visible text of a product page, one blank between pieces.

    Elements without technical content go whole, those of their own kind inside them included; what an element without an end
    tag began goes to the end of the page.
    """
    text = F.regexp_replace(html, r"(?s)<!--.*?-->|<![^>]*>", " ")
    text = F.regexp_replace(text, rf"(?is)<({'|'.join(_RAW)})\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    text = F.regexp_replace(_without_nested(text), r"(?s)<[/a-zA-Z][^>]*>", " ")
    return F.coalesce(squish(decoded(text)), F.lit(""))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def url_host(url: Column) -> Column:
    """Host and port.  What stands before the last ``@`` of the authority is a user name, not a host."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(authority, "^.*@", ""))


def url_allowed(
    url: Column, brand: Column | None = None, vocab: Vocabulary = DEFAULT, domains=None
) -> Column:
    """https only, public host, and the host lies in an approved brand domain.

    ``domains`` replaces the approved list; with ``brand`` only that brand's domain counts.
    """
    host = F.split_part(url_host(url), F.lit(":"), F.lit(1))
    https = F.coalesce(F.lower(url).startswith("https://"), F.lit(False))
    private = host.isin(LOCAL_HOSTS) | (host.rlike(IP_LITERAL) & host.rlike(RESERVED_IP))
    bare = _bare(host)
    if brand is not None:
        approved = _bare(F.lower(lookup(vocab.domains, strip(brand))))
        inside = (bare == approved) | F.endswith(bare, F.concat(F.lit("."), approved))
    else:
        names = [d.lower().removeprefix("www.") for d in (domains or vocab.domains.values())]
        # every suffix of the host is looked up, so cost does not grow with the list
        labels = F.split(bare, r"\.")
        suffixes = F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )
        inside = F.arrays_overlap(suffixes, F.array(*[F.lit(n) for n in names]))
    return F.coalesce(https & (host != "") & ~private & inside, F.lit(False))


def official_url(brand: Column, mpn: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """Candidate product page on the brand's site; null without a known domain."""
    domain = lookup(vocab.domains, strip(brand))
    return F.when(
        domain.isNotNull() & (mpn != ""),
        F.concat(F.lit("https://"), domain, F.lit("/products/"), F.lower(strip(mpn))),
    )


def json_from_reply(reply: Column) -> Column:
    """The JSON object inside a model reply: fenced, or the outermost braces, or the whole text."""
    fenced = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
    braces = r"(?s)(\{.*\})"
    return (
        F.when(reply.rlike(fenced), F.regexp_extract(reply, fenced, 1))
        .when(reply.rlike(braces), F.regexp_extract(reply, braces, 1))
        .otherwise(strip(reply))
    )


def reply_status(reply: Column) -> Column:
    """OK for a reply that is one JSON object after its code fence is removed, else the reason."""
    fence = r"(?is)^```(?:json)?\s*"
    text = strip(F.regexp_replace(F.regexp_replace(strip(reply), fence, ""), r"(?s)\s*```$", ""))

    def judge(t: Column) -> Column:
        parsed = F.try_parse_json(t)
        return (
            F.when(t.isNull() | (t == ""), "Empty LLM content")
            .when(parsed.isNull(), "JSONDecodeError")
            .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "Parsed JSON is not a dictionary")
            .otherwise("OK")
        )

    return let(text, judge)


def upload_verdict(name: Column, content: Column) -> Column:
    """Why an uploaded catalog file is refused; null when it is acceptable.  ``content`` is binary."""
    lower = F.lower(name)
    text = F.lower(F.decode(content, "ISO-8859-1"))
    dangerous = F.lit(False)
    for pattern in DANGEROUS_CONTENT:
        dangerous = dangerous | F.contains(text, F.lit(pattern))
    magic = F.hex(F.substring(content, 1, 4))
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "EMPTY_NAME")
        .when(~lower.rlike(r"\.(csv|xlsx)$"), "EXTENSION")
        .when(magic.startswith("4D5A") | (magic == "7F454C46"), "EXECUTABLE")
        .when(lower.endswith(".xlsx") & (magic != "504B0304"), "NOT_A_WORKBOOK")
        .when(lower.endswith(".csv") & dangerous, "ACTIVE_CONTENT")
    )
