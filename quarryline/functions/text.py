"""Tokenizers and text expressions, all built from JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the code tokenizer.
CODE_STOP_WORDS = (
    "def class self return if else elif for while try except finally with as import from in is not and or true false none "
    "function const let var this new async await"
).split()

# Stop words of the query tokenizer.
QUERY_STOP_WORDS = (
    "the a an is are was were be been have has had do does did will would could should may might must can need "
    "to of in for on with at by from as into through during before after and but if or because until while "
    "this that these those i me my we you your it its they them their what which who how where when why "
    "add create make build implement write fix update change modify remove delete"
).split()

# What the keyword extractor drops beside the query tokenizer's stop words.
KEYWORD_STOP_WORDS = [*QUERY_STOP_WORDS, "please", "help", "want", "like", "using", "use"]


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty one may stand at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def tokens(text: Column, stop: list[str] | tuple[str, ...] = tuple(CODE_STOP_WORDS)) -> Column:
    """Words of more than two characters that are no stop words; repeats stay."""
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*stop))


def query_tokens(text: Column) -> Column:
    return tokens(text, QUERY_STOP_WORDS)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def split_lines(text: Column) -> Column:
    """Lines without the empty one after a final line break."""
    own = lines(text)
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))).otherwise(own)


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 16)


def occurrences(text: Column, needle: str) -> Column:
    """How often the needle occurs without overlap; an empty one before each character and at the end."""
    if not needle:
        return (F.length(text) + 1).cast("int")
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def edited(text: Column, search: Column, new: Column, every: bool = False) -> Column:
    """struct(content, replacements, error): the first or every occurrence replaced. An edit that changes nothing but blanks
    around the text is refused, as is one whose text doesn't occur or whose file isn't there; content is then as it was."""
    at = F.position(search, text)
    first = F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(search)))
    n = F.when(F.length(search) == 0, F.length(text) + 1).otherwise(((F.length(text) - F.length(F.replace(text, search, F.lit("")))) / F.length(search)).cast("int"))
    error = F.when(text.isNull(), "File not found").when(F.trim(search) == F.trim(new), "Edit changes nothing").when(at == 0, "Search text not found")
    content = F.replace(text, search, new) if every else first
    return F.struct(F.when(error.isNull(), content).otherwise(text).alias("content"), F.when(error.isNull(), n if every else F.lit(1)).otherwise(0).alias("replacements"), error.alias("error"))


def replace_first(text: Column, needle: str, new: str) -> Column:
    at = F.instr(text, needle)
    return F.when(at == 0, text).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), F.lit(new), F.substr(text, at + len(needle))))


def truncate_lines(text: Column, limit: int, marker: str = "\n... (truncated)") -> Column:
    own = lines(text)
    return F.when(F.size(own) > limit, F.concat(F.array_join(F.slice(own, 1, limit), "\n"), F.lit(marker))).otherwise(F.array_join(own, "\n"))


def smart_truncate(text: Column, limit: int | Column, marker: str = "\n... (truncated)") -> Column:
    """Cut at limit, back to the last line break where that lies beyond 80 % of it."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.substr(text, F.lit(1), limit)
    last = limit - F.instr(F.reverse(head), "\n")  # characters before the break
    cut = F.when((F.instr(head, "\n") > 0) & (last > limit * 0.8), F.substr(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(marker)))


def contains_all(text: Column, needles: list[str]) -> Column:
    """struct(valid, found, missing): the needles that the text has and lacks; valid if it has all, null for a null text."""
    wanted, own = F.array(*map(F.lit, needles)), F.coalesce(text, F.lit(""))
    valid = F.when(text.isNotNull(), F.forall(wanted, lambda n: F.contains(own, n)))
    return F.struct(valid.alias("valid"), F.filter(wanted, lambda n: F.contains(own, n)).alias("found"), F.filter(wanted, lambda n: ~F.contains(own, n)).alias("missing"))


def path_of(url: Column) -> Column:
    """The path of a URL without query and fragment."""
    return F.regexp_extract(url, r"^[a-z]+://[^/]*(/[^?#]*)", 1)


# Command classes in order of test, and the substrings that show them.
COMMAND_PROFILES = {
    "install": ["pip install", "npm install", "yarn add", "cargo add", "go get"],
    "run": ["python ", "node ", "go run", "cargo run", "npm start", "npm run dev"],
    "test": ["pytest", "npm test", "cargo test", "go test", "jest", "vitest"],
    "build": ["npm run build", "cargo build", "go build", "tsc", "webpack", "vite build"],
}


def command_class(command: Column) -> Column:
    """The first profile with a substring that occurs: install, run, test, build; else 'default'."""
    out = F.lit("default")
    for name, parts in reversed(COMMAND_PROFILES.items()):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.lower(command).contains(p)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out
