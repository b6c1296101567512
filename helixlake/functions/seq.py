"""Sequence functions as columns: built-in expressions only, so that they stay inside the JVM.

Sequences are ASCII strings. Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- fixed values: complements of IUPAC letters, for DNA and RNA, case kept
DNA_LETTERS, DNA_COMPLEMENTS = "ABCDGHKMNRSTVWYabcdghkmnrstvwy", "TVGHCDMKNYSABWRtvghcdmknysabwr"
RNA_LETTERS, RNA_COMPLEMENTS = "ABCDGHKMNRSUVWYXabcdghkmnrsuvwyx", "UVGHCDMKNYSABWRXuvghcdmknysabwrx"
# ---- fixed values: bases of each IUPAC letter, in the order in which variants are listed
IUPAC = {"G": "G", "A": "A", "T": "T", "C": "C", "R": "GA", "Y": "TC", "M": "AC", "K": "GT", "S": "GC", "W": "AT", "H": "ACT", "B": "GTC", "V": "GCA", "D": "GAT", "N": "GATC"}
# ---- fixed values: nearest-neighbour enthalpy (kcal/mol) and entropy (cal/mol/K)
NEAREST_NEIGHBOURS = {
    "AA": (-7.6, -21.3), "TT": (-7.6, -21.3), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9),
}
INITIATION, SYMMETRY, TERMINAL_AT = (0.2, -5.7), (0.0, -1.4), (2.2, 6.9)
GAS_CONSTANT = 1.9872


def _complement(s: Col, letters: str, complements: str, strict: bool) -> Column:
    """Letters that have no complement stay, or become U+0000 when strict."""
    x = _c(s)
    x = F.regexp_replace(x, f"[^{letters}]", "\u0000") if strict else x
    return F.translate(x, letters, complements)


def complement(s: Col, strict: bool = False) -> Column:
    return _complement(s, DNA_LETTERS, DNA_COMPLEMENTS, strict)


def reverse(s: Col) -> Column:
    return F.reverse(_c(s))


def reverse_complement(s: Col, strict: bool = False) -> Column:
    return F.reverse(complement(s, strict))


def complement_rna(s: Col, strict: bool = False) -> Column:
    return _complement(s, RNA_LETTERS, RNA_COMPLEMENTS, strict)


def reverse_complement_rna(s: Col, strict: bool = False) -> Column:
    return F.reverse(complement_rna(s, strict))


def complement_base(base: Col, rna: bool = False) -> Column:
    """Of one letter; a letter without complement gives a space."""
    letters, complements = (RNA_LETTERS, RNA_COMPLEMENTS) if rna else (DNA_LETTERS, DNA_COMPLEMENTS)
    return F.translate(F.regexp_replace(_c(base), f"[^{letters}]", " "), letters, complements)


def canonical(s: Col) -> Column:
    """Upper case, the smaller of both strands."""
    up = F.upper(_c(s))
    return F.least(up, reverse_complement(up))


# ---- predicates


def is_palindromic(s: Col) -> Column:
    return _c(s) == reverse_complement(s)


def is_dna(s: Col) -> Column:
    return _c(s).rlike("^[ACGT]*$")


def is_rna(s: Col) -> Column:
    return _c(s).rlike("^[ACGU]*$")


def is_foldable_rna(s: Col) -> Column:
    """At least one letter, only ACGU."""
    return _c(s).rlike("^[ACGU]+$")


def is_dot_bracket(s: Col) -> Column:
    return _c(s).rlike("^[().]+$")


def gc_content(s: Col) -> Column:
    """Share of G and C; NaN for an empty sequence."""
    x = F.upper(_c(s))
    n = F.length(x)
    return F.when(n == 0, F.lit(float("nan"))).when(n > 0, (n - F.length(F.translate(x, "GC", ""))) / n)


def is_primary_alignment(flag: Col) -> Column:
    """Neither secondary nor supplementary."""
    return _c(flag).bitwiseAND(0x900) == 0


# ---- k-mers and sketches


def kmers(s: Col, k: int) -> Column:
    """All k-mers in order; an empty array for shorter sequences. One pass over the text (substrings would each count from
    its start)."""
    return F.regexp_extract_all(_c(s), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def canonical_kmers(s: Col, k: int) -> Column:
    """Canonical k-mers in order: k-mers of both strands side by side, the smaller of each pair."""
    x = F.upper(_c(s))
    return F.zip_with(kmers(x, k), F.reverse(kmers(reverse_complement(x), k)), lambda a, b: F.least(a, b))


def kmer_counts(s: Col, k: int) -> Column:
    """Canonical k-mers of a sequence, each once: array of (kmer, n), n being the places that hold it."""
    from .codec import kmer_counts_column

    x = F.upper(_c(s))
    return kmer_counts_column(k)(x, reverse_complement(x))


def sketch(s: Col, k: int, size: int, hash: str = "prefix4") -> Column:
    """Bottom-`size` sketch of sliding k-mers, the last one left out, duplicates kept.

    ``prefix4`` takes the first four bytes of a k-mer as its value; ``crc32`` and ``xxhash64`` are real hashes. Of fewer
    than `size` k-mers the values stand in order of place and are filled up with zeros.
    """
    x = _c(s)
    n = F.greatest(F.length(x) - k, F.lit(0))
    words = kmers(x, k)
    cut = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    value = {
        "prefix4": lambda w: F.conv(F.hex(F.substring(w, 1, 4)), 16, 10).cast("bigint"),
        "crc32": lambda w: F.crc32(w.cast("binary")),
        "xxhash64": lambda w: F.xxhash64(w).bitwiseAND(0xFFFFFFFF),
    }[hash]
    values = F.transform(cut, value)
    short = F.concat(values, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(size) - n, F.lit(0))))
    whole = F.when(n >= size, F.slice(F.sort_array(values), 1, size)).otherwise(short)
    if hash != "prefix4":
        return whole
    from .align import prefix_sketch_column

    # a sketch of prefixes needs no k-mers; the expressions are for letters beyond ASCII
    return F.when(F.octet_length(x) == F.length(x), prefix_sketch_column(k, size)(x)).otherwise(whole)


# ---- variants, alphabets, translation


def variants_iupac(s: Col) -> Column:
    """All expansions of degenerate letters, the last place running fastest; an error for other letters."""
    table = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (k, v)])
    letters = F.filter(F.split(F.upper(_c(s)), ""), lambda c: c != "")
    bases = lambda c: F.split(F.coalesce(F.try_element_at(table, c), F.raise_error(F.concat(F.lit("Error:"), c, F.lit(" is not a supported IUPAC character")))), "")
    grow = lambda acc, c: F.flatten(F.transform(acc, lambda p: F.transform(F.filter(bases(c), lambda b: b != ""), lambda b: F.concat(p, b))))
    return F.aggregate(letters, F.array(F.lit("")), grow)


def encode_symbol(symbol: Col, alphabet: list[str]) -> Column:
    """Index of a symbol (the last one of equal symbols); an error for one that is not in the alphabet."""
    index = {s: i for i, s in enumerate(alphabet)}
    table = F.create_map(*[F.lit(x) for k, v in index.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, _c(symbol)), F.raise_error(F.concat(F.lit("Symbol "), _c(symbol), F.lit(" not in alphabet"))).cast("int"))


def decode_symbol(code: Col, alphabet: list[str]) -> Column:
    """Symbol of an index; an error outside of the alphabet."""
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in alphabet]), _c(code)), F.raise_error(F.concat(F.lit("Code "), _c(code).cast("string"), F.lit(" not in alphabet"))))


def codons(s: Col) -> Column:
    """Upper-case triplets in frame; a shorter tail is dropped."""
    return F.regexp_extract_all(F.upper(_c(s)), F.lit("(?s)(.{3})"), F.lit(1))


def translate(s: Col, table: dict[str, str]) -> Column:
    """Protein of a coding sequence; unknown triplets give nothing. `table` maps triplets to letters."""
    known = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    return F.array_join(F.transform(codons(s), lambda c: F.coalesce(F.try_element_at(known, c), F.lit(""))), "")


# ---- melting temperature, primers, barcodes


def marmur_doty(s: Col) -> Column:
    x = F.upper(_c(s))
    count = lambda letters: F.length(x) - F.length(F.translate(x, letters, ""))
    return (2 * count("AT") + 4 * count("CG") - 7).cast("double")


def santa_lucia(s: Col, primer: float = 500e-9, salt: float = 50e-3, magnesium: float = 0.0) -> Column:
    """Struct of tm (Celsius), dh, ds. Pairs that are not in the table add nothing."""
    x = F.upper(_c(s))
    n = F.length(x)
    h, e = (F.create_map(*[F.lit(v) for pair, he in NEAREST_NEIGHBOURS.items() for v in (pair, float(he[k]))]) for k in (0, 1))
    own = x == reverse_complement(x)
    last = F.substring(x, -1, 1).isin("A", "T")
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(x, i, F.lit(2))), lambda p: F.length(p) == 2)
    total = lambda table, start: F.aggregate(pairs, start, lambda a, p: a + F.coalesce(F.try_element_at(table, p), F.lit(0.0)))
    h0 = F.lit(INITIATION[0]) + F.when(own, SYMMETRY[0]).otherwise(0.0) + F.when(last, TERMINAL_AT[0]).otherwise(0.0)
    e0 = F.lit(INITIATION[1]) + F.when(own, SYMMETRY[1]).otherwise(0.0) + F.when(last, TERMINAL_AT[1]).otherwise(0.0) + F.lit(0.368) * (n - 1) * F.log(F.lit(salt + magnesium * 140))
    dh, ds = total(h, h0), total(e, e0)
    tm = dh * 1000 / (ds + GAS_CONSTANT * F.log(F.lit(primer) / F.when(own, 1.0).otherwise(4.0))) - 273.15
    return F.when(n > 0, F.struct(tm.alias("tm"), dh.alias("dh"), ds.alias("ds")))


def melting_temperature(s: Col) -> Column:
    return santa_lucia(s).tm


def design_primers(s: Col, target: float, forward_overhang: str = "", reverse_overhang: str = "", shortest: int = 15, longest: int = 60) -> Column:
    """Struct of forward and reverse: grown from 15 nt at each end until they melt at `target`; null when none does."""
    from .melting import primer_length_column

    x = F.upper(_c(s))
    length = primer_length_column(target, shortest, longest)
    forward, back = (F.substring(v, F.lit(1), length(v)) for v in (x, reverse_complement(x)))
    return F.when(F.length(x) >= shortest, F.struct(F.concat(F.lit(forward_overhang), forward).alias("forward"), F.concat(reverse_complement(F.lit(reverse_overhang)), back).alias("reverse")))


# ---- seqhash

_TYPES = {"DNA": 0, "RNA": 1, "PROTEIN": 2, "FRAGMENT": 3}


def encode_flag(version: int, kind: str, circular: bool, double: bool) -> int:
    """The first byte of a hash: version, circular, double-stranded, kind."""
    return version << 4 | circular << 3 | double << 2 | _TYPES[kind]


def decode_flag(flag: Col) -> Column:
    """Struct of version, kind, circular, double_stranded."""
    f = _c(flag).cast("int")
    kind = F.element_at(F.array(*[F.lit(k) for k in _TYPES]), f.bitwiseAND(3) + 1)
    return F.struct(F.shiftright(f, 4).alias("version"), kind.alias("kind"), (f.bitwiseAND(8) != 0).alias("circular"), (f.bitwiseAND(4) != 0).alias("double_stranded"))


def least_rotation(s: Col) -> Column:
    """Smallest rotation by built-in functions; quadratic, for short sequences (codec.least_rotation_column is linear)."""
    # the array binds the doubled sequence, which the rotations are cut from, to a name
    twice = lambda d: F.array_min(F.transform(F.sequence(F.lit(1), (F.length(d) / 2).cast("int")), lambda i: F.substring(d, i, (F.length(d) / 2).cast("int"))))
    x = _c(s)
    return F.when(F.length(x) > 0, F.get(F.transform(F.array(F.concat(x, x)), twice), F.lit(0))).otherwise(x)


def _linear_rotation(s: Column) -> Column:
    from .codec import least_rotation_column

    return least_rotation_column(s)


def seqhash_bytes(s: Col, kind: str = "DNA", circular: bool = False, double: bool = False, rotate=_linear_rotation) -> Column:
    """16 bytes: flag and the first 15 bytes of SHA-256 of the canonical form; an error for letters that the kind lacks."""
    if kind not in ("DNA", "RNA", "PROTEIN"):
        raise ValueError(f"Only sequenceTypes of DNA, RNA, or PROTEIN allowed. Got sequenceType: {kind}")
    if kind == "PROTEIN" and double:
        raise ValueError("Proteins cannot be double stranded")
    x = F.upper(_c(s))
    x = F.replace(x, F.lit("U"), F.lit("T")) if kind == "RNA" else x
    letters, what = ("ACDEFGHIKLMNPQRSTVWYUO*BXZ", "Proteins") if kind == "PROTEIN" else ("ATUGCYRSWKMBDHVNZ", "DNA/RNA")
    other = F.regexp_extract(x, f"([^{letters}])", 1)
    x = F.when(other == "", x).when(x.isNotNull(), F.raise_error(F.concat(F.lit(f"Only letters {letters} are allowed for {what}. Got letter: "), other)))
    form = lambda v: rotate(v) if circular else v
    best = F.least(form(x), form(reverse_complement(x))) if double else form(x)
    return F.unhex(F.concat(F.lit(f"{encode_flag(2, kind, circular, double):02X}"), F.substring(F.sha2(best, 256), 1, 30)))


def seqhash_fragment_bytes(s: Col, forward: Col, reverse_: Col) -> Column:
    """16 bytes: flag, both overhang lengths (swapped with the strand), 13 bytes of SHA-256. Upper case only."""
    x = _c(s)
    other = F.regexp_extract(x, "([^ATUGCYRSWKMBDHVNZ])", 1)
    x = F.when(other == "", x).when(x.isNotNull(), F.raise_error(F.concat(F.lit("Only letters ATUGCYRSWKMBDHVNZ are allowed for DNA/RNA. Got letter: "), other)))
    r = reverse_complement(x)
    byte = lambda n: F.lpad(F.hex(n.cast("int").bitwiseAND(255)), 2, "0")
    f, b = byte(_c(forward)), byte(_c(reverse_))
    flag = F.lit(f"{encode_flag(2, 'FRAGMENT', False, False):02X}")
    return F.unhex(F.concat(flag, F.when(x > r, F.concat(b, f)).otherwise(F.concat(f, b)), F.substring(F.sha2(F.least(x, r), 256), 1, 26)))


# ---- energy helpers


def delta_g(dh: Col, ds: Col, kelvin: Col | float) -> Column:
    t = F.lit(kelvin) if isinstance(kelvin, (int, float)) else _c(kelvin)
    return _c(dh) - t * _c(ds) / 1000.0


def jacobson_stockmayer(length: Col, known: int, energy: Col | float, kelvin: float) -> Column:
    """Energy of a loop longer than the tables."""
    g = F.lit(energy) if isinstance(energy, (int, float)) else _c(energy)
    return g + F.lit(2.44 * 1.9872e-3 * kelvin) * F.log(_c(length) / F.lit(float(known)))
