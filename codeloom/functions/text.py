"""Column functions on text: word n-gram fingerprints, lines, edit similarity. All stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[a-zA-Z0-9_]+"
_HEX = re.compile("[0-9a-f]{16}")
#: A line end as Python's splitlines() sees it.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: White space as Python's \s sees it: Unicode's, and four separators that Java leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda an expression would be computed at every step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(as_column(text), F.lit(WORD), F.lit(0))


def _windows(text: Column | str, n: int, of) -> Column:
    """`of` each space-joined window of n words: word arrays shifted against each other are joined pairwise, so no window is cut out by itself."""
    if n < 2:
        raise ValueError("n must be 2 or more")
    shifted = lambda w, j, last: F.slice(w, j + 1, last)

    def windows(w: Column) -> Column:
        last = F.greatest(F.size(w) - (n - 1), F.lit(0))
        grams = shifted(w, 0, last)
        for j in range(1, n):
            joined = lambda a, b: F.concat(a, F.lit(" "), b)
            grams = F.zip_with(grams, shifted(w, j, last), (lambda a, b: of(joined(a, b))) if j == n - 1 else joined)
        return F.when(F.size(w) == 0, F.lit(None)).when(F.size(w) < n, F.array(of(F.array_join(w, " ")))).otherwise(grams)

    return let(words(text), windows)


def ngrams(text: Column | str, n: int = 2) -> Column:
    """Space-joined windows of n words, repeats kept; fewer words give one gram of them all; none give NULL."""
    return _windows(text, n, lambda gram: gram)


def fingerprint_hash(gram: Column | str) -> Column:
    """64 bits as 16 hex digits: the values are unsigned and don't fit a bigint."""
    return F.substring(F.md5(as_column(gram).cast("binary")), 1, 16)


def ngram_fingerprint(text: Column | str, n: int = 2) -> Column:
    return _windows(text, n, fingerprint_hash)


def packed(fingerprint: Column | str) -> Column:
    """A fingerprint array as 8 bytes a value, where all are 16 hex digits; NULL for others. unpacked() gives the array again."""
    fp = as_column(fingerprint)
    digits = F.array_join(fp, "")
    fits = (F.length(digits) == 16 * F.size(fp)) & digits.rlike("^[0-9a-f]*$") & F.forall(fp, lambda h: F.length(h) == 16)
    return F.when(fits, F.unhex(digits))


def short_bytes(value: str) -> bytes:
    """One value as a posting holds it: 16 hex digits as their 8 bytes, any other text behind 9 zero bytes."""
    return bytes.fromhex(value) if _HEX.fullmatch(value) else bytes(9) + value.encode()


def unpacked(digits: Column | str) -> Column:
    def values(held: Column) -> Column:
        n = (F.octet_length(held) / 8).cast("int")
        one = lambda i: F.lower(F.hex(F.substring(held, i * 8 + 1, F.lit(8))))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), one))

    return let(as_column(digits), values)


def from_json_fingerprint(json: Column | str) -> Column:
    """A JSON list of unsigned integers as 16-digit hex strings; what can't be parsed is NULL."""
    numbers = F.from_json(as_column(json), "array<decimal(20,0)>")
    high, low = lambda x: F.floor(x / 4294967296).cast("bigint"), lambda x: (x % 4294967296).cast("bigint")
    return F.transform(numbers, lambda x: F.lower(F.concat(F.lpad(F.hex(high(x)), 8, "0"), F.lpad(F.hex(low(x)), 8, "0"))))


def ascii_lower(text: Column | str) -> Column:
    return F.translate(as_column(text), _UPPER, _LOWER)


def contains_ascii_folded(text: Column | str, keyword: str) -> Column:
    """Whether text holds keyword literally; only A-Z match either case."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in keyword)
    return F.contains(ascii_lower(text), F.lit(folded))


def extension(path: Column | str) -> Column:
    """The suffix of the last path part, as Path.suffix: none for dot files and trailing dots."""
    name = F.regexp_extract(as_column(path), r"([^/]*)/*$", 1)
    return F.when(F.rtrim(name).rlike(r"^\.*[^.].*\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise("")


def language_of(ext: Column | str, languages: dict[str, str]) -> Column:
    """By extension, letter case counted; NULL if unknown."""
    pairs = [F.lit(x) for kv in languages.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), as_column(ext))


def normal_line_ends(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(as_column(text), F.lit("")), r"\r\n?", "\n")


def first_line(text: Column | str) -> Column:
    """The text before the first line feed, CR and CRLF counted as such; NULL as ''."""
    return F.substring_index(normal_line_ends(text), "\n", 1)


def without_space(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), SPACE, "")


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - distance / longer length, in code points; two empty texts are alike."""
    a, b = as_column(a), as_column(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def lines(text: Column | str) -> Column:
    """splitlines(): no empty last element, no lines in an empty text."""
    t = as_column(text)
    parts = F.split(t, LINE_END, -1)
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(cut)


def tail_lines(text: Column | str, n: int) -> Column:
    """The last n lines joined by line feeds; NULL gives ''. n = 0 means all, as a slice from -0 does."""


    def last(found: Column) -> Column:
        size = F.size(found)
        if n > 0:
            return F.when(size > n, F.slice(found, size - n + 1, n)).otherwise(found)
        return found if n == 0 else F.when(size > -n, F.slice(found, 1 - n, size + n)).otherwise(F.array().cast("array<string>"))

    return F.array_join(let(lines(F.coalesce(as_column(text), F.lit(""))), last), "\n")


def tail_lines_with_ends(text: Column | str, n: int) -> Column:
    """struct(text, line_count, char_count) of the last n lines with their line ends; none for n <= 0."""
    t = F.coalesce(as_column(text), F.lit(""))
    found = F.regexp_extract_all(t, F.lit(rf"(?s)(?:(?!{LINE_END}).)*(?:{LINE_END})|(?:(?!{LINE_END}).)+$"), F.lit(0))
    size = F.size(found)
    tail = F.when(size > n, F.slice(found, size - n + 1, n)).otherwise(found) if n > 0 else F.array().cast("array<string>")
    joined = F.array_join(tail, "")
    return F.struct(joined.alias("text"), F.size(tail).alias("line_count"), F.length(joined).alias("char_count"))


def python_strip(text: Column | str) -> Column:
    """strip(): white space of Unicode at both ends."""
    return F.regexp_replace(as_column(text), rf"{SPACE.replace('+', '')}+$|(?U)^[\s\x1c-\x1f]+", "")


def reference_path(ref: Column) -> Column:
    """repository/path, or the one that is there, or ''."""
    repo, path = F.coalesce(ref["repository"], F.lit("")), F.coalesce(ref["relative_path"], F.lit(""))
    return F.when((repo != "") & (path != ""), F.concat(repo, F.lit("/"), path)).when(path != "", path).otherwise(repo)


def reference_path_or_name(ref: Column) -> Column:
    """As reference_path(), then the qualified name, then UNKNOWN."""
    path, name = reference_path(ref), F.coalesce(ref["qualified_name"], F.lit(""))
    return F.when(path != "", path).when(name != "", name).otherwise("UNKNOWN")


def reference_body(ref: Column) -> Column:
    """A reference as a prompt shows it: of functions the text before the first brace, ended by a semicolon; else all of it."""
    text = python_strip(normal_line_ends(ref["text"]))
    head = python_strip(F.substring_index(text, "{", 1))
    signature = F.when((head != "") & ~F.endswith(head, F.lit(";")), F.concat(head, F.lit(";"))).otherwise(head)
    return F.when(F.contains(F.lower(F.coalesce(ref["kind"], F.lit(""))), F.lit("function")), signature).otherwise(text)


def reference_segment(ref: Column, index: Column) -> Column:
    """The header line with index, path and kind, and the body."""
    header = F.concat(F.lit("/* Retrieved reference "), index.cast("string"), F.lit(": "), reference_path(ref), F.lit(" | "), F.coalesce(ref["kind"], F.lit("")), F.lit(" */\n"))
    body = reference_body(ref)
    return F.when(body != "", F.concat(header, body, F.lit("\n\n"))).otherwise(F.concat(header, F.lit("\n")))


def location(path: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.format_string("%s:%s-%s", as_column(path), as_column(start), as_column(end))


def coverage(candidate: Column | str, wanted: Column | str) -> Column:
    """|C & R| / |R| of two sets; 0 if R is empty."""
    c, r = F.array_distinct(as_column(candidate)), F.array_distinct(as_column(wanted))
    return F.when(F.size(r) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(c, r)) / F.size(r))


def residual(candidate: Column | str, wanted: Column | str) -> Column:
    """R without C."""
    return F.array_except(as_column(wanted), as_column(candidate))


def ordered_names(names: list[Column]) -> Column:
    """Distinct names, first occurrence kept, empty ones dropped, joined by commas."""
    return F.array_join(F.array_distinct(F.filter(F.array(*names), lambda x: x != "")), ",")


def fold_structure(child_digests: Column | str) -> Column:
    """An inner node's full digest from its children's: a left fold of md5 from '0'."""
    return F.aggregate(as_column(child_digests), F.lit("0"), lambda h, c: F.md5(F.concat(h, c).cast("binary")))


def leaf_digest(node_type: Column | str) -> Column:
    return F.md5(F.concat(F.lit("0"), F.md5(as_column(node_type).cast("binary"))).cast("binary"))


def _json_value(json: Column | str, field: str) -> tuple[Column, Column]:
    """A field of a JSON object as a variant, and its type's name; NULL for what can't be parsed, and VOID for a JSON null."""
    v = F.try_variant_get(F.try_parse_json(as_column(json)), f"$.{field}", "variant")
    return v, F.schema_of_variant(v)


def json_float(json: Column | str, field: str) -> Column:
    """A field's value if it is a JSON number or truth value, never from a string."""
    v, kind = _json_value(json, field)
    number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|BOOLEAN)"), number)


def json_int(json: Column | str, field: str) -> Column:
    """A field's value if it is a JSON integer or truth value; numbers with a fraction don't count."""
    v, kind = _json_value(json, field)
    return F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint")).when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def has_bit(bits: Column, bit: Column) -> Column:
    """Whether a bitmap of bitmap_construct_agg has a bit."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
