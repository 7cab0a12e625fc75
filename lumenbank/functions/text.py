"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Curly and plain forms, and words that carry no content.
CURLY, PLAIN = "‘’“”–— ", "''\"\"-- "
STOPWORDS = "the and for with that this from are was were has have its into than then which when what who how why all any not but can may will".split()


def squash(c: Column) -> Column:
    """White space collapsed to single spaces, and trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))


def dedup_norm(c: Column) -> Column:
    """Folded quotes and dashes, lower case, hyphens and slashes as spaces, no sentence punctuation; % $ and digits stay."""
    c = F.lower(F.translate(c, CURLY, PLAIN))
    return squash(F.regexp_replace(F.regexp_replace(c, "[-/]", " "), r"[.,;:!?\"'()]", ""))


def plain_norm(c: Column) -> Column:
    """Letters and digits only; a minus before a number becomes the word neg."""
    c = F.regexp_replace(F.lower(c), r"-([0-9])", "neg $1")
    return squash(F.regexp_replace(c, r"[^a-z0-9]+", " "))


def strip_figures(c: Column) -> Column:
    return squash(F.regexp_replace(c, r"[$]?[0-9][0-9,.]*%?", " "))


def slug(c: Column, sep: str = "-") -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", sep), F.lit(sep))


def humanize(c: Column, overrides: dict[str, str] | None = None) -> Column:
    """Title case of a slug, with whole-slug overrides."""
    named = F.initcap(F.translate(c, "-_", "  "))
    for key, value in (overrides or {}).items():
        named = F.when(c == key, value).otherwise(named)
    return named


def content_hash(stem: Column, options: Column) -> Column:
    """Twelve hex digits over the stem and the options in letter order."""
    return F.left(F.sha1(F.concat_ws("‖", stem, *[options[x] for x in "ABCD"])), F.lit(12))


def stem_hash(stem: Column) -> Column:
    return F.left(F.sha1(stem), F.lit(12))


def tokens(c: Column, least: int = 3) -> Column:
    """Runs of a-z and 0-9 of three or more characters that are not stop words."""
    found = F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " ")
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(STOPWORDS))


def light_stem(w: Column) -> Column:
    """A word without its commonest ending, then without a final e."""
    cut = F.regexp_replace(w, "(ing|ed|es|ly|s)$", "")
    cut = F.when(F.length(cut) >= 3, cut).otherwise(w)
    return F.regexp_replace(cut, "e$", "")


def stems(c: Column) -> Column:
    return F.array_distinct(F.transform(tokens(c), light_stem))


def word_ngrams(words: Column, n: int) -> Column:
    """(gram, start) of each n words in a row; ``words`` must be a plain column, since each gram reads it."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("gram"), i.alias("start")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(F.array_union(a, b))), F.lit(0.0))


def coverage(a: Column, b: Column) -> Column:
    """Share of ``a`` that ``b`` has; 0 when empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def figures(c: Column) -> Column:
    """Numbers of a text, without $ , and %."""
    found = F.regexp_extract_all(c, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), 1)
    return F.transform(found, lambda x: F.translate(x, ",", "").cast("double"))


def figures_agree(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Whether some number of ``a`` is within the tolerance of one of ``b``."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y))))


def gist(c: Column, n: int = 12) -> Column:
    """The first n words, with an ellipsis if there are more."""
    words = F.split(squash(c), " ")
    return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, "…").otherwise(""))


def excerpt(c: Column, n: int = 800) -> Column:
    return F.left(squash(c), F.lit(n))


def claim_supported(claim: Column, prose: Column) -> Column:
    """The claim stands in the prose word for word, or its numbers all do and six in ten of its words."""
    flat = lambda c: F.concat(F.lit(" "), plain_norm(c), F.lit(" "))
    words, have = tokens(claim), tokens(prose)
    numbers = F.forall(figures(claim), lambda x: F.array_contains(figures(prose), x))
    return F.contains(flat(prose), flat(claim)) | (numbers & (coverage(F.array_distinct(words), F.array_distinct(have)) >= 0.6))


def restates(term: Column, definition: Column) -> Column:
    """Whether a definition, after an article, begins with the term's words."""
    return F.startswith(F.concat(F.regexp_replace(plain_norm(definition), "^(a|an|the) ", ""), F.lit(" ")), F.concat(plain_norm(term), F.lit(" ")))
