"""Gene design: barcodes, overhang sets, fragmentation, codon choice and repair of coding sequences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import ClassVar, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cloning import revcomp

# ---- barcodes from a de Bruijn string


def de_bruijn(n: int, letters: str = "ATGC") -> str:
    """The cyclic string of all words of n letters, as the Lyndon words of lengths that divide n, in order, wrapped by n-1.

    Lyndon words come one after the other by Duval's rule: repeat the word to n letters, drop the last letters of the
    alphabet from its end, raise the last one that is left.
    """
    top, out, word = len(letters) - 1, [], [0]
    while word:
        if n % len(word) == 0:
            out += word
        word = (word * n)[:n]
        while word and word[-1] == top:
            word.pop()
        if word:
            word[-1] += 1
    s = "".join(letters[i] for i in out)
    return s + s[: n - 1]


def barcodes(length: int, longest_shared: int, banned: Iterable[str] = (), allowed: Iterable[Callable[[str], bool]] = ()) -> list[str]:
    """Windows of the de Bruijn string that share no word of `longest_shared` letters.

    A window with a banned word (on either strand), or one that a predicate refuses, slides on by one letter. Every slide
    also counts as a window, so later windows are left out.
    """
    s = de_bruijn(longest_shared)
    step = length - (longest_shared - 1)
    bad = [lambda w, b=b: b in w for word in banned for b in (word, revcomp(word))] + [lambda w, f=f: not f(w) for f in allowed]
    out, number = [], 0
    while number * step + length < len(s):
        at = number * step
        number += 1
        for refuses in bad:
            while refuses(s[at : at + length]):
                if at + length + 1 > len(s):
                    return out
                at += 1
                number += 1
        out.append(s[at : at + length])
    return out


def gc_share(s: str) -> float:
    up = s.upper()
    return (up.count("G") + up.count("C")) / len(s) if s else float("nan")


def barcodes_gc(length: int, longest_shared: int, least: float, most: float) -> list[str]:
    return barcodes(length, longest_shared, allowed=[lambda w: least <= gc_share(w) <= most])


def barcode_table(spark: SparkSession, length: int, longest_shared: int) -> DataFrame:
    """ordinal, barcode of plain barcodes, cut by Spark from the one string."""
    s, step = de_bruijn(longest_shared), length - (longest_shared - 1)
    n = max(0, -(-(len(s) - length) // step))
    return spark.range(n).select(F.col("id").alias("ordinal"), F.substring(F.lit(s), (F.col("id") * step + 1).cast("int"), F.lit(length)).alias("barcode"))


# ---- overhang sets

Fidelity = dict[tuple[str, str], int]


def read_fidelity(df: DataFrame, limit: int = 65_536) -> Fidelity:
    """Counts of ligations by (overhang, partner) from columns x, y, n; all pairs of 4-letter overhangs are 65,536."""
    rows = df.select("x", "y", "n").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a fidelity table has at most {limit} rows")
    return {(r.x, r.y): r.n for r in rows}


def set_efficiency(overhangs: list[str], fidelity: Fidelity) -> float:
    """Product over the set of right ligations by all ligations within it. Missing pairs count 0; an overhang without
    wrong ones leaves the product as it is."""
    out = 1.0
    for x in overhangs:
        right = fidelity.get((x, x), 0)
        total = sum(fidelity.get((x, z), 0) for y in overhangs for z in (y, revcomp(y)))
        if total != right:
            out *= right / total
    return out


def next_overhangs(current: list[str], fidelity: Fidelity) -> list[tuple[str, float]]:
    """Every overhang that may be added, with the mean efficiency of the set with either strand of it."""
    taken = {y for x in current for y in (x, revcomp(x))}
    words = [a + b + c + d for a in "ATGC" for b in "ATGC" for c in "ATGC" for d in "ATGC"]
    return [(w, (set_efficiency([*current, w], fidelity) + set_efficiency([*current, revcomp(w)], fidelity)) / 2) for w in words if w not in taken and w != revcomp(w)]


def next_overhang(current: list[str], fidelity: Fidelity) -> str:
    best = max(next_overhangs(current, fidelity), key=lambda x: x[1], default=("", 0.0))
    return best[0] if best[1] > 0 else ""


def set_efficiency_native(sets: DataFrame, fidelity: DataFrame) -> DataFrame:
    """set_id, efficiency for sets (set_id, ordinal, overhang) and fidelity (x, y, n), by joins; the product in order."""
    from . import seq

    right = sets.join(fidelity.where("x = y").select(F.col("x").alias("overhang"), F.col("n").alias("hit")), "overhang", "left")
    others = sets.select("set_id", F.explode(F.array(F.col("overhang"), seq.reverse_complement("overhang"))).alias("y"))
    total = sets.join(others, "set_id").join(fidelity.withColumnRenamed("x", "overhang"), ["overhang", "y"], "left").groupBy("set_id", "ordinal").agg(F.sum(F.coalesce("n", F.lit(0))).alias("all"))
    hit = F.coalesce("hit", F.lit(0))
    factor = right.join(total, ["set_id", "ordinal"]).select("set_id", "ordinal", F.when(hit == F.col("all"), 1.0).otherwise(hit / F.col("all")).alias("f"))
    one = factor.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "f"))).alias("fs"))
    return one.select("set_id", F.aggregate("fs", F.lit(1.0), lambda a, x: a * x.f).alias("efficiency"))


_DIGITS = np.full(128, 4)
_DIGITS[[ord(c) for c in "ACGT"]] = range(4)


def _codes(s: str) -> np.ndarray | None:
    """Numbers of the words of four letters at every place; none for letters besides ACGT, or too few."""
    if len(s) < 4 or not s.isascii():
        return None
    d = _DIGITS[np.frombuffer(s.encode(), np.uint8)]
    return None if d.max() > 3 else ((d[:-3] * 4 + d[1:-2]) * 4 + d[2:-1]) * 4 + d[3:]


class Ligations:
    """A fidelity table, and by numbers of words: ligations with either strand of a word, and with its own complement."""

    def __init__(self, fidelity: Fidelity):
        self.fidelity = fidelity
        words = [a + b + c + d for a in "ACGT" for b in "ACGT" for c in "ACGT" for d in "ACGT"]
        number = {w: k for k, w in enumerate(words)}
        self.back = np.array([number[revcomp(w)] for w in words])
        counts = np.array([[fidelity.get((x, y), 0) for y in words] for x in words], np.int64)
        self.both, self.right = counts + counts[:, self.back], counts.diagonal().astype(float)


class _Words:
    """An overhang set that grows, by words: for any letters."""

    def __init__(self, sequence: str, overhangs: list[str], allowed: set[str], known: Ligations):
        self.s, self.used, self.allowed, self.fidelity = sequence, overhangs, allowed, known.fidelity

    def best(self, start: int, longest: int, least: int) -> tuple[float, int]:
        taken = {y for x in self.used for y in (x, revcomp(x))}
        rest = self.s[start:]
        choice = [(at, rest[at - 4 : at]) for at in range(longest, least - 1, -1)]
        scored = [(set_efficiency([*self.used, w], self.fidelity), -k, at) for k, (at, w) in enumerate(choice) if w not in taken and w != revcomp(w) and (not self.allowed or w in self.allowed)]
        value, _, at = max(scored, default=(0.0, 0, 0))
        return value, at

    def add(self, start: int, at: int) -> None:
        self.used.append(self.s[start:][at - 4 : at])

    def efficiency(self) -> float:
        return set_efficiency(self.used, self.fidelity)


class _Numbers:
    """The same by numbers: ligations of the members are added up as they come, so that all choices of a cut cost a step for
    each member. Products run in the same order as in `set_efficiency`."""

    def __init__(self, codes: np.ndarray, overhangs: list[int], allowed: np.ndarray | None, known: Ligations):
        self.codes, self.known = codes, known
        self.free = known.back != np.arange(256)
        if allowed is not None:
            self.free &= allowed
        self.used, self.totals = np.array([], np.int64), np.array([], np.int64)
        for w in overhangs:
            self._add(w)

    def _add(self, w: int) -> None:
        both = self.known.both
        self.totals = np.append(self.totals + both[self.used, w], both[w, self.used].sum() + both[w, w])
        self.used = np.append(self.used, w)
        self.free[[w, self.known.back[w]]] = False

    def best(self, start: int, longest: int, least: int) -> tuple[float, int]:
        first = start + longest - 4
        place = np.flatnonzero(self.free[self.codes[first - max(longest - least, -1) : first + 1][::-1]])
        if not len(place):
            return 0.0, 0
        w, both, right = self.codes[first - place], self.known.both, self.known.right
        total = np.concatenate([both[self.used[:, None], w] + self.totals[:, None], both[w[:, None], self.used].sum(axis=1)[None] + both[w, w]])
        hit = np.concatenate([np.broadcast_to(right[self.used][:, None], (len(self.used), len(w))), right[w][None]])
        value = np.multiply.reduce(np.divide(hit, total, out=np.ones_like(hit), where=total != hit), axis=0)
        k = int(value.argmax())
        return float(value[k]), longest - int(place[k])

    def add(self, start: int, at: int) -> None:
        self._add(int(self.codes[start + at - 4]))

    def efficiency(self) -> float:
        out = 1.0
        for hit, total in zip(self.known.right[self.used].tolist(), self.totals.tolist(), strict=True):
            if total != hit:
                out *= hit / total
        return out


def _overhang_set(sequence: str, exclude: list[str], allowed: set[str], known: Ligations) -> _Numbers | _Words:
    ends, codes = [sequence[:4], sequence[-4:], *exclude], _codes(sequence)
    numbers = [_codes(w) if len(w) == 4 else None for w in ends]
    if codes is None or any(x is None for x in numbers):
        return _Words(sequence, ends, allowed, known)
    may = None
    if allowed:
        may = np.zeros(256, bool)
        may[[int(x[0]) for w in allowed if len(w) == 4 and (x := _codes(w)) is not None]] = True
    return _Numbers(codes, [int(x[0]) for x in numbers], may, known)


# ---- fragmentation


def fragment(sequence: str, least: int, most: int, fidelity: Fidelity | Ligations, exclude: Iterable[str] = (), include: Iterable[str] = ()) -> tuple[list[str], float]:
    """(fragments, efficiency). Cuts from the left, each where the overhang set stays best; neighbours share 4 letters.
    What is left and shorter than two pieces is cut in the middle. The least size, once made smaller, stays so."""
    s, start = sequence.upper(), 0
    used = _overhang_set(s, list(exclude), {y for x in include for y in (x, revcomp(x))}, fidelity if isinstance(fidelity, Ligations) else Ligations(fidelity))
    out: list[str] = []
    while (left := len(s) - start) >= most:
        if least > most:
            raise ValueError(f"minFragmentSize ({least}) larger than maxFragmentSize ({most})")
        if least < 12:
            raise ValueError(f"minFragmentSize must be equal to or greater than 12 . Got size of {least}")
        longest = most
        if left < 2 * most:
            longest = left // 2
            least = max(12, longest - (most - least))
        value, at = used.best(start, longest, least)
        if value <= 0:
            raise ValueError("bestOverhangPosition failed by equaling zero")
        out.append(s[start : start + at])
        used.add(start, at)
        start += at - 4
    return [*out, s[start:]], used.efficiency()


@dataclass
class Assembly:
    sequence: str
    fragments: list[str] = field(default_factory=list)
    efficiency: float = 0.0
    parts: list[Assembly] = field(default_factory=list)

    def rows(self, parent: int = -1, level: int = 0, start: int = 0) -> list[dict]:
        """The tree in preorder: node, parent, level, sequence, fragments, efficiency."""
        out = [{"node": start, "parent": parent, "level": level, "sequence": self.sequence, "fragments": self.fragments, "efficiency": self.efficiency}]
        for p in self.parts:
            out += p.rows(start, level + 1, start + len(out))
        return out


def recursive_fragment(sequence: str, oligo: int, pattern: list[int], fidelity: Fidelity | Ligations, exclude: Iterable[str] = (), include: Iterable[str] = (), forward_flank: str = "", reverse_flank: str = "", level: int = 0) -> Assembly:
    """Assemblies of assemblies: level i holds pattern[i] pieces of the level below, down to oligos. Flanks are put on all
    but the whole sequence."""
    sequence = sequence.replace("\n", "")
    sizes = [(oligo - len(forward_flank) - len(reverse_flank)) * pattern[0]]
    for k in pattern[1:]:
        sizes.append(sizes[-1] * k - 60)
    whole = forward_flank + sequence + reverse_flank if level else sequence
    fits = next((i for i, size in enumerate(sizes) if len(sequence) <= size), None)
    if fits is None:
        raise ValueError("Fragment too long!")
    if fits == 0:
        return Assembly(sequence, *fragment(whole, oligo - 60, oligo, fidelity, exclude, include))
    below = sizes[fits - 1]
    pieces, efficiency = fragment(whole, below - 100, below, fidelity, exclude, include)
    return Assembly(sequence, [], efficiency, [recursive_fragment(p, oligo, pattern, fidelity, exclude, include, forward_flank, reverse_flank, level + 1) for p in pieces])


def fragment_column(least: int, most: int, fidelity: Fidelity, exclude: Iterable[str] = (), include: Iterable[str] = ()):
    """f(sequence) -> struct of fragments, efficiency, error."""
    known = Ligations(fidelity)

    @F.pandas_udf("fragments array<string>, efficiency double, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                rows.append((*fragment(x, least, most, known, exclude, include), None) if x is not None else (None, None, None))
            except ValueError as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["fragments", "efficiency", "error"])

    return run


def recursive_fragment_column(oligo: int, pattern: list[int], fidelity: Fidelity, exclude: Iterable[str] = (), include: Iterable[str] = (), forward_flank: str = "", reverse_flank: str = ""):
    """f(sequence) -> struct of nodes (preorder), error."""
    known = Ligations(fidelity)

    @F.pandas_udf("nodes array<struct<node:int,parent:int,level:int,sequence:string,fragments:array<string>,efficiency:double>>, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                rows.append((recursive_fragment(x, oligo, pattern, known, exclude, include, forward_flank, reverse_flank).rows(), None) if x is not None else (None, None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["nodes", "error"])

    return run


# ---- codon choice

#: Letter to (triplet, weight) in the order of the table.
Codons = dict[str, list[tuple[str, int]]]


def as_codons(table: DataFrame) -> Codons:
    """A codon table (one table_id) as a dictionary; 64 rows."""
    out: Codons = {}
    for r in table.select("letter", "triplet", "weight").limit(4096).collect():
        out.setdefault(r.letter, []).append((r.triplet, r.weight))
    return {k: sorted(v) for k, v in sorted(out.items())}


def draw_codon(choices: list[tuple[str, int]], rng: np.random.Generator) -> str:
    weights = np.cumsum([w for _, w in choices])
    if not weights[-1]:
        raise ValueError("codons without weight")
    return choices[int(np.searchsorted(weights, rng.integers(0, weights[-1]), side="right"))][0]


def optimize(protein: str, codons: Codons, seed: int) -> str:
    """Codons drawn by weight, one stream for each protein and seed."""
    if not protein:
        raise ValueError("empty amino acid string")
    rng, out = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF), []
    for letter in protein.upper():
        if letter not in codons:
            raise ValueError(f"amino acid {letter} is invalid")
        out.append(draw_codon(codons[letter], rng))
    return "".join(out)


def optimize_column(codons: Codons):
    """f(protein, seed) -> struct of dna, error."""

    @F.pandas_udf("dna string, error string")
    def run(protein: pd.Series, seed: pd.Series) -> pd.DataFrame:
        rows = []
        for p, s in zip(protein, seed, strict=True):
            try:
                rows.append((optimize(p, codons, int(s)), None) if p is not None else (None, None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["dna", "error"])

    return run


# ---- repair of coding sequences


class Suggestion(NamedTuple):
    """Codons start..end (both included) need `fixes` changes; bias is NA, GC or AT."""

    start: int
    end: int
    bias: str
    fixes: int
    reason: str


class Change(NamedTuple):
    position: int
    step: int
    before: str
    after: str
    reason: str


Check = Callable[[str], list[Suggestion]]


def remove_sequences(sites: Iterable[str], reason: str) -> Check:
    """Sites (patterns) on either strand."""
    words = [(w, re.compile(w), re.escape(w) == w) for s in sites for w in dict.fromkeys((s, revcomp(s)))]

    def check(s: str) -> list[Suggestion]:
        return [Suggestion(m.start() // 3, m.end() // 3 - 1, "NA", 1, reason) for w, pattern, plain in words if not plain or w in s for m in pattern.finditer(s)]

    return check


def remove_repeats(length: int) -> Check:
    """Words that were seen before on either strand. The last word of a sequence is not looked at, and after a find out of
    frame as many letters are skipped as it is out of frame."""

    def check(s: str) -> list[Suggestion]:
        back, n = revcomp(s), len(s)
        if n > length and len({s[at : at + length] for at in range(n - length)} | {back[at : at + length] for at in range(1, n - length + 1)}) == 2 * (n - length):
            return []
        seen: set[str] = set()
        out, at = [], 0
        while at < n - length:
            word = s[at : at + length]
            known = word in seen or back[n - at - length : n - at] in seen
            seen.add(word)
            if known:
                shift = at % 3
                out.append(Suggestion(at // 3, (at + length) // 3 - (1 if shift else 0), "NA", 1, "Repeat sequence"))
                at += shift
            at += 1
        return out

    return check


def keep_gc(most: float, least: float) -> Check:
    def check(s: str) -> list[Suggestion]:
        gc, end = gc_share(s), len(s) // 3 - 1
        if gc > most:
            return [Suggestion(0, end, "AT", int((gc - most) * len(s)) + 1, "GcContent too high")]
        if gc < least:
            return [Suggestion(0, end, "GC", int((least - gc) * len(s)) + 1, "GcContent too low")]
        return []

    return check


class Synonyms:
    """Other triplets of the same letter, by share. Choices are kept from sequence to sequence."""

    fits: ClassVar[dict[str, Callable[[int, int], bool]]] = {"NA": lambda a, b: True, "GC": lambda a, b: b > a, "AT": lambda a, b: b < a}

    def __init__(self, codons: Codons):
        self.share: dict[str, float] = {}
        self.others: dict[str, list[str]] = {}
        self.known: dict[tuple[str, tuple[str, ...]], tuple[int, float, str]] = {}
        self.whole = all(sum(w for _, w in choices) for choices in codons.values())
        if not self.whole:
            return
        for choices in codons.values():
            total = sum(w for _, w in choices)
            for t, w in choices:
                self.share[t] = 100 * w / total
                self.others[t] = [x for x, _ in choices if x != t]

    def choice(self, bias: str, tried: tuple[str, ...]) -> tuple[int, float, str]:
        """Of a place that had these triplets: number of triplets that are left, negative share of the greatest and itself."""
        if (bias, tried) not in self.known:
            gc = lambda t: sum(c in "GC" for c in t)
            last = tried[-1]
            free = [t for t in self.others.get(last, []) if t not in tried and self.fits[bias](gc(last), gc(t))]
            top = max(free, key=self.share.__getitem__, default="")
            found = (len(free), -self.share[top] if top else 0.0, top)
            if last not in self.others:
                return found  # no triplet of the table; such words are not kept
            self.known[bias, tried] = found
        return self.known[bias, tried]


def repair(sequence: str, codons: Codons | Synonyms, checks: Iterable[Check], rounds: int = 100) -> tuple[str, list[Change]]:
    """Synonymous changes until no check complains; the codon of the greatest share first, no codon twice at a place."""
    if len(sequence) % 3:
        raise ValueError("this sequence isn't a complete CDS, please try to use a CDS without interrupted codons")
    synonyms = codons if isinstance(codons, Synonyms) else Synonyms(codons)
    if not synonyms.whole:
        raise ValueError("incomplete codon table")
    history = [(sequence[i : i + 3],) for i in range(0, len(sequence), 3)]
    checks, changes, known = list(checks), [], synonyms.known
    for step in range(rounds + 1):
        now = "".join([h[-1] for h in history])
        found = [x for check in checks for x in check(now)]
        if not found:
            return now, sorted(changes, key=lambda c: (c.step, c.position))
        if step == rounds:
            break
        for want in found:
            if want.bias not in synonyms.fits:
                raise ValueError(f"Invalid bias. Expected NA, GC, or AT, got {want.bias}")
            options, best = 0, []
            for place, tried in enumerate(history[want.start : want.end + 1], want.start):
                n, share, top = known.get((want.bias, tried)) or synonyms.choice(want.bias, tried)
                if n:
                    options += n
                    best.append((share, place, top))
            if len(best) < want.fixes:
                raise ValueError(f"Too many fixes required. Number of potential fixes: {options} , number of required fixes: {want.fixes}")
            for _, place, top in [min(best)] if want.fixes == 1 else sorted(best)[: want.fixes]:
                changes.append(Change(place, step, history[place][-1], top, want.reason))
                history[place] += (top,)
    raise ValueError(f"not repaired in {rounds} rounds")


def simple_checks(remove: Iterable[str]) -> list[Check]:
    return [remove_sequences(["AAAAAAAA", "GGGGGGGG"], "Homopolymers"), remove_sequences(remove, "Removal requested by user"), remove_repeats(18), keep_gc(0.80, 0.20)]


def repair_column(codons: Codons, remove: Iterable[str] = (), rounds: int = 100):
    """f(sequence) -> struct of sequence, changes, error."""
    remove = list(remove)

    @F.pandas_udf("sequence string, changes array<struct<position:int,step:int,before:string,after:string,reason:string>>, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows, synonyms, checks = [], Synonyms(codons), simple_checks(remove)
        for x in s:
            try:
                if x is None:
                    rows.append((None, None, None))
                    continue
                fixed, changes = repair(x, synonyms, checks, rounds)
                rows.append((fixed, [c._asdict() for c in changes], None))
            except ValueError as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["sequence", "changes", "error"])

    return run
