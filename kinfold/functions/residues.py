"""Column expressions over residue strings and edit paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.model import ALPHABET

TOKENS = ALPHABET + "-"
PAD_LENGTH = 512
WRAP = 60


def from_text(text: Column) -> Column:
    """The 20 letters of free text in either case, in upper case; all else goes first."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{ALPHABET}{ALPHABET.lower()}]", ""))


def clean(residues: Column, strip_gaps: bool = True) -> Column:
    """White space goes, dots are gaps, gaps go if asked for, letters become upper case."""
    found = F.upper(F.translate(F.regexp_replace(residues, r"\s+", ""), ".", "-"))
    return F.translate(found, "-", "") if strip_gaps else found


def valid(residues: Column, allow_star: bool = False) -> Column:
    return F.regexp_like(residues, F.lit(r"^[A-Za-z*-]*$" if allow_star else r"^[A-Za-z-]*$"))


def first_word(header: Column) -> Column:
    return F.regexp_extract(header, r"^\s*(\S*)", 1)


def letter_at(residues: Column, at: Column) -> Column:
    return F.substring(residues, at, F.lit(1))


def between(residues: Column, start: Column, end: Column) -> Column:
    """Letters start to end, counted from 1, both included."""
    return F.substring(residues, start, end - start + 1)


def letters(residues: Column) -> Column:
    """Array of the letters; empty for an empty string."""
    return F.when(F.length(residues) > 0, F.split(residues, "")).otherwise(F.array().cast("array<string>"))


def wrapped(residues: Column, width: int = WRAP) -> Column:
    """Lines of width letters, each ended by a line feed."""
    return F.regexp_replace(residues, f"(.{{1,{width}}})", "$1\n")


def fasta_record(header: Column, residues: Column, width: int = WRAP) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), wrapped(residues, width))


def tokens(residues: Column) -> Column:
    """Numbers of the letters in TOKENS from 1; unknown letters are left out."""
    place = F.transform(letters(F.upper(residues)), lambda x: F.instr(F.lit(TOKENS), x))
    return F.filter(place, lambda k: k > 0)


def padded(numbers: Column, length: int = PAD_LENGTH) -> Column:
    """The last length numbers, with zeros before them."""
    last = F.when(F.size(numbers) > length, F.slice(numbers, -length, length)).otherwise(numbers)
    return F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(length) - F.size(numbers))), last)


def one_hot(cls: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == cls, 1).otherwise(0))


def highlighted(residues: Column, scores: Column, cutoff: float) -> Column:
    """Letters in upper case where the score reaches cutoff, else in lower case."""
    marked = F.zip_with(letters(residues), scores, lambda x, s: F.when(s >= cutoff, F.upper(x)).otherwise(F.lower(x)))
    return F.array_join(marked, "")


def with_gaps(residues: Column, path: Column, own: str) -> Column:
    """Residues spread along an edit path: a letter at B and at own (X or Y), else a gap."""
    steps = letters(path)
    taken = F.transform(F.sequence(F.lit(1), F.length(path)), lambda k: F.length(F.translate(F.substring(path, F.lit(1), k), "BXY".replace("B", "").replace(own, ""), "")))
    here = F.zip_with(steps, taken, lambda s, k: F.when((s == "B") | (s == own), F.substring(residues, k, F.lit(1))).otherwise("-"))
    return F.when(F.length(path) > 0, F.array_join(here, "")).otherwise("")


def gap_columns(residues: Column) -> Column:
    """Numbers, from 1, of the columns without a gap."""
    marked = F.transform(letters(residues), lambda x, k: F.when(x != "-", k + 1))
    return F.filter(marked, lambda k: k.isNotNull())
