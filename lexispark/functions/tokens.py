"""Column functions on n-grams and tokens; all stay in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TAGS

_TAG = "(" + "|".join(t.replace(".", "[.]") for t in TAGS) + ")"

#: Tag of a token -> part of speech of the lemma table; others take the table's default.
LEMMA_POS = {"NOUN": "n", "PROPN": "n", "VERB": "v", "ADJ": "a", "ADV": "r"}


def tokens(text: Column, separators: str = r"[ \t\n\r]+") -> Column:
    """The tokens of a text, none empty."""
    return F.filter(F.split(text, separators), lambda t: t != "")


def word_of(token: Column) -> Column:
    """What stands before the last underscore; the whole token without one."""
    return F.when(token.contains("_"), F.regexp_extract(token, r"^(.*)_([^_]*)$", 1)).otherwise(token)


def pos_of(token: Column) -> Column:
    return F.when(token.contains("_"), F.regexp_extract(token, r"^(.*)_([^_]*)$", 2))


def split_known_tag(token: Column) -> Column:
    """struct(word, pos): split only where the suffix is a tag of the tag set."""
    tagged = token.rlike(f"^.*_{_TAG}$")
    return F.struct(F.when(tagged, F.regexp_extract(token, f"^(.*)_{_TAG}$", 1)).otherwise(token).alias("word"), F.when(tagged, F.regexp_extract(token, f"^(.*)_{_TAG}$", 2)).alias("pos"))


def is_tagged(ngram: Column) -> Column:
    """Every token ends in a tag and has a base; one trailing blank is allowed."""
    return F.forall(F.split(F.regexp_replace(ngram, " $", ""), " "), lambda t: t.rlike(f"^.+_{_TAG}$"))


def is_untagged(ngram: Column) -> Column:
    """No tag occurs anywhere, and no blank leads or doubles."""
    return ~ngram.rlike(f"_{_TAG}") & ~ngram.rlike("  |^ ")


def ngram_type(kind: str):
    """The predicate of 'tagged', 'untagged' or 'all'."""
    kinds = {"tagged": is_tagged, "untagged": is_untagged, "all": lambda c: c.isNotNull()}
    if kind not in kinds:
        raise ValueError(f"n-gram type must be one of {sorted(kinds)}, not {kind!r}")
    return kinds[kind]


def prefix_key(toks: Column, depth: int) -> Column:
    """First letters of the first ``depth`` tokens; ``_`` where there is no a-z."""
    first = F.transform(F.slice(toks, 1, depth), lambda t: F.left(F.lower(F.left(t, F.lit(1))), F.lit(1)))
    letters = F.transform(first, lambda c: F.when(c.between("a", "z"), c).otherwise(F.lit("_")))
    return F.rpad(F.coalesce(F.array_join(letters, ""), F.lit("")), depth, "_")


def log_weight(freq: Column, base: float = 10.0) -> Column:
    """max(1, floor(log_base(freq + 1))), with the quotient of natural logs (999 weighs 2 at base 10)."""
    return F.greatest(F.lit(1), F.floor(F.ln(freq.cast("double") + 1.0) / F.ln(F.lit(float(base))))).cast("int")


@dataclass(frozen=True)
class TokenFilter:
    """Which tokens pass. ``None`` or empty sets switch a test off; sets are small and inlined."""

    stops: tuple[str, ...] = ()
    numerals: bool = True
    nonalpha: bool = True
    min_length: int = 3
    vocabulary: tuple[str, ...] | None = None

    def reason(self, token: Column) -> Column:
        """The first test a token fails, null if it passes: vocab, stop, numeral, nonalpha, short."""
        low, out = F.lower(token), F.lit(None).cast("string")
        tests = [
            ("short", F.length(token) < self.min_length, self.min_length > 0),
            ("nonalpha", token.rlike("[^a-zA-Z]"), self.nonalpha),
            ("numeral", token.rlike("[0-9]"), self.numerals),
            ("stop", low.isin(list(self.stops)), bool(self.stops)),
            ("vocab", ~low.isin(list(self.vocabulary or ())), self.vocabulary is not None),
        ]
        for name, fails, on in tests:
            out = F.when(fails, F.lit(name)).otherwise(out) if on else out
        return out


    def passes(self, token: Column) -> Column:
        """Whether no test fails; cheap tests first."""
        low, out = F.lower(token), F.length(token) >= self.min_length
        if self.nonalpha:
            out &= ~token.rlike("[^a-zA-Z]")  # digits are no letters, so this covers numerals
        elif self.numerals:
            out &= ~token.rlike("[0-9]")
        if self.stops:
            out &= ~low.isin(list(self.stops))
        return out if self.vocabulary is None else out & low.isin(list(self.vocabulary))


def marked(toks: Column, spec: TokenFilter) -> Column:
    """The tokens, null where one fails."""
    return F.transform(toks, lambda t: F.when(spec.passes(t), t))


def survivors(marks: Column, min_tokens: int = 2, unk: str | None = None, count_unk: bool = True) -> Column:
    """The n-gram that ``marked`` tokens leave, or null for one that is dropped; see ``filtered``."""
    passed = F.size(F.array_compact(marks))
    counted = F.size(marks) if unk is not None and count_unk else passed
    return F.when((counted >= min_tokens) & (passed > 0), F.array_join(marks, " ", unk) if unk is not None else F.array_join(marks, " "))


def filtered(toks: Column, spec: TokenFilter, min_tokens: int = 2, unk: str | None = None, count_unk: bool = True) -> Column:
    """Surviving tokens joined by blanks, or null for an n-gram that is dropped.

    Failing tokens are removed, or replaced by ``unk`` if given. An n-gram is dropped with fewer than
    ``min_tokens`` tokens (``count_unk``: markers count) or with nothing but markers.
    """
    return survivors(marked(toks, spec), min_tokens, unk, count_unk)


def normalised_key(ngram: Column, lower=False, alpha=False, shorts: int = 0, stops: tuple[str, ...] = (), lemmas: dict[tuple[str, str], str] | None = None, unk: str = "<UNK>") -> Column:
    """The normalised key of an n-gram; failing tokens become ``unk``, none is dropped.

    Steps in order: split known tags, lower, alpha (letters only), shorts, stops, lemmas (only where a
    tag is known; a small inlined table keyed by word and part of speech).
    """
    out = F.transform(tokens(ngram), split_known_tag)
    word = lambda f: lambda t: F.struct(f(t["word"], t["pos"]).alias("word"), t["pos"].alias("pos"))
    if lower:
        out = F.transform(out, word(lambda w, p: F.lower(w)))
    if alpha:
        out = F.transform(out, word(lambda w, p: F.when(w.rlike(r"^\p{L}+$"), w).otherwise(F.lit(unk))))
    if shorts:
        out = F.transform(out, word(lambda w, p: F.when((F.length(w) >= shorts) | (w == unk), w).otherwise(F.lit(unk))))
    if stops:
        out = F.transform(out, word(lambda w, p: F.when(w.isin(list(stops)), F.lit(unk)).otherwise(w)))
    if lemmas:
        table = F.create_map(*(F.lit(x) for (w, p), lemma in lemmas.items() for x in (f"{w}/{p}", lemma)))
        tags = F.create_map(*(F.lit(x) for kv in LEMMA_POS.items() for x in kv))
        out = F.transform(out, word(lambda w, p: F.when(p.isNotNull(), F.coalesce(F.try_element_at(table, F.concat(w, F.lit("/"), F.coalesce(F.try_element_at(tags, p), F.lit("n")))), w)).otherwise(w)))
    return F.array_join(F.transform(out, lambda t: t["word"]), " ")


def not_metadata(ngram: Column) -> Column:
    return ~F.startswith(ngram, F.lit("__"))
