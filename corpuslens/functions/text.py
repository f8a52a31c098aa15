"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``\\s`` has it, line breaks as ``str.splitlines`` has them.
SPACE = r"(?U)[\s\x1c-\x1f]+"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Tool names, trigger and dependency patterns and stop words (fixed values).
TOOLS = ["Bash", "Read", "Write", "Edit", "Glob", "Grep", "Task", "WebFetch", "WebSearch", "TodoWrite", "AskUserQuestion", "MCP", "mcp-cli"]
TRIGGERS = [r"[Uu]se this (?:skill|agent) when[^.]*\.", r"[Tt]rigger(?:s|ed)? (?:by|when|with)[^.]*\.", r"[Uu]se for[^.]*\."]
DEPENDENCIES = [r"[Rr]equires? ([a-zA-Z0-9_-]+)", r"[Dd]epends? on ([a-zA-Z0-9_-]+)", r"[Nn]eeds? ([a-zA-Z0-9_-]+)"]
STOP = ["the", "a", "an", "to", "be"]
DEFINITION = r"(?U)^\s*(?:def|class|function|const|let|var)\s+(\w+)"


def bound(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value worked out once, even where ``use`` mentions it many times."""
    return F.transform(F.array(value), use)[0]


def shingles(text: Column, size: int = 3) -> Column:
    """The set of word shingles of a text; of texts with fewer words the words, of texts without words runs of as many
    characters of what is left, or that itself."""
    flat = F.trim(F.regexp_replace(F.lower(text), SPACE, " "))
    left = F.regexp_replace(flat, r"[^a-z0-9 \-]", "")

    def of(residue: Column) -> Column:
        n = F.length(residue)
        chars = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(residue, i, F.lit(size)))

        def by_words(words: Column) -> Column:
            m = F.size(words)
            runs = F.transform(F.sequence(F.lit(1), m - size + 1), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
            none = F.array().cast("array<string>")
            return F.when(m >= size, runs).when(m > 0, words).when(n >= size, chars).when(n > 0, F.array(residue)).otherwise(none)

        return F.array_distinct(bound(F.filter(F.split(residue, " "), lambda w: w != ""), by_words))

    return bound(left, of)


def hash28(s: Column) -> Column:
    """The first 28 bits of an MD5: a hash that any engine with MD5 shares."""
    return F.conv(F.substring(F.md5(s), 1, 7), 16, 10).cast("long")


def signature(sets: Column, slots: int = 128) -> Column:
    """MinHash: for each of ``slots`` linear functions modulo 2^31 - 1 the least value over the set; null if empty."""

    number = lambda name: int(hashlib.md5(name.encode()).hexdigest()[:7], 16)  # noqa: E731, S324
    functions = F.array(*[F.struct(F.lit(number(f"a{k}") + 1).cast("long").alias("a"), F.lit(number(f"b{k}")).cast("long").alias("b")) for k in range(slots)])

    def of(hashes: Column) -> Column:
        return F.transform(functions, lambda p: F.array_min(F.transform(hashes, lambda h: (p["a"] * h + p["b"]) % F.lit((1 << 31) - 1))))

    return F.when(F.size(sets) > 0, bound(F.transform(sets, hash28), of))


def estimate(a: Column, b: Column, slots: int = 128) -> Column:
    """The share of equal slots of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(slots))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def lines(text: Column) -> Column:
    """``str.splitlines``: an end after the last line opens no new one."""
    parts = F.split(text, BREAK)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(bound(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def tools(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, TOOLS)), lambda t: F.regexp_like(text, F.concat(F.lit(r"(?i)\b"), t, F.lit(r"\b"))))


def triggers(text: Column) -> Column:
    return F.concat(*[F.slice(F.regexp_extract_all(text, F.lit(p), 0), 1, 3) for p in TRIGGERS])


def dependencies(text: Column) -> Column:
    found = F.concat(*[F.slice(F.regexp_extract_all(text, F.lit(p), 1), 1, 5) for p in DEPENDENCIES])
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: ~F.lower(d).isin(STOP))))


def complexity(n_lines: Column, n_words: Column, n_tools: Column) -> Column:
    high = (n_lines > 200) | (n_words > 1500) | (n_tools > 5)
    medium = (n_lines > 80) | (n_words > 600) | (n_tools > 2)
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def normalized_lines(text: Column) -> Column:
    """Lines without white space at their ends and with one space for each four columns of indent; a tab is four."""

    def one(line: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(line, SPACE + "$", ""), "^" + "(?U)[\\s\\x1c-\\x1f]+", "")
        lead = F.regexp_extract(line, "^(" + SPACE + ")", 1)
        width = F.length(F.regexp_replace(lead, "\t", "    "))
        return F.when(body == "", F.lit("")).otherwise(F.concat(F.repeat(F.lit(" "), F.floor(width / 4).cast("int")), body))

    return F.transform(lines(text), one)


def definitions(normalized: Column) -> Column:
    found = F.transform(normalized, lambda x: F.regexp_extract(x, DEFINITION, 1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: d != "")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_official(marketplace: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | marketplace.startswith(p)
    return out


def plugin_of(path: Column) -> Column:
    """The part after the first ``plugins`` of a relative path, else the first folder, else ``root``."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "plugins").cast("int")
    return F.when((at > 0) & (at < F.size(parts)), F.element_at(parts, F.greatest(at, F.lit(1)) + F.when(at < F.size(parts), 1).otherwise(0))).when(F.size(parts) > 1, parts[0]).otherwise("root")


def kind_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.array_contains(parts, "skills"), "skill").when(F.array_contains(parts, "agents"), "agent")


def name_of(path: Column) -> Column:
    """A file's stem, or its folder's name for ``SKILL``."""
    stem, parts = F.regexp_replace(file_name(path), r"\.[^.]*$", ""), F.split(path, "/")
    return F.when((stem == "SKILL") & (F.size(parts) > 1), F.element_at(parts, F.when(F.size(parts) > 1, -2).otherwise(-1))).otherwise(stem)


def body_of(text: Column) -> Column:
    """A text without its front matter."""
    return F.regexp_replace(text, r"(?Us)\A---.*?\n---\s*\n", "")


def description_of(text: Column, most: int = 200, least: int = 0) -> Column:
    """The first body line that is neither empty nor a heading nor a list item, cut off."""
    stripped = F.transform(F.split(body_of(text), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "^" + SPACE, ""), SPACE + "$", ""))
    plain = F.filter(stripped, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-") & (F.length(x) > least))
    return F.coalesce(F.substring(F.get(plain, F.lit(0)), 1, most), F.lit(""))


def search_score(query: Column, name: Column, description: Column, phrases: Column) -> Column:
    """Lexical relevance: case-insensitive substrings of the whole query or of its words, by field."""
    q = F.lower(query)
    words = F.array_distinct(F.filter(F.split(q, SPACE), lambda w: w != ""))
    n, d = F.lower(name), F.lower(description)
    by_name = F.when(F.contains(n, q), 10.0).when(F.exists(words, lambda w: F.contains(n, w)), 5.0).otherwise(0.0)
    by_text = F.when(F.contains(d, q), 5.0).otherwise(2.0 * F.size(F.filter(words, lambda w: F.contains(d, w))))
    one = lambda t: F.when(F.contains(F.lower(t), q), 3.0).when(F.exists(words, lambda w: F.contains(F.lower(t), w)), 1.0).otherwise(0.0)
    return by_name + by_text + F.aggregate(phrases, F.lit(0.0), lambda a, t: a + one(t))
