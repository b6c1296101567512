import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.functions import align, cloning, codec, design, seq
from helixlake.operators import barcoding, codons, matching, pileups

revcomp = cloning.revcomp


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column.alias("x")).first().x


def test_complements(spark):
    assert one(spark, "ATGCNryKM", seq.reverse_complement("s")) == "KMryNGCAT"
    assert one(spark, "AUGX", seq.reverse_complement_rna("s")) == "XCAU"
    assert one(spark, "A-T", seq.complement("s")) == "T-A" and one(spark, "A-T", seq.complement("s", strict=True)) == "T\0A"
    assert one(spark, "-", seq.complement_base("s")) == " " and one(spark, "U", seq.complement_base("s", rna=True)) == "A"
    assert one(spark, None, seq.reverse_complement("s")) is None


def test_variants(spark):
    got = one(spark, "ATGGARAAYGAYGARCTN", seq.variants_iupac("s"))
    assert len(got) == 64 and got[:2] == ["ATGGAGAATGATGAGCTG", "ATGGAGAATGATGAGCTA"] and len(set(got)) == 64
    with pytest.raises(Exception, match="not a supported IUPAC"):
        one(spark, "AX", seq.variants_iupac("s"))


def test_melting(spark):
    assert one(spark, "ACGTCCGGACTT", seq.marmur_doty("s")) == 31
    assert one(spark, "ACGATGGCAGTAGCATGC", seq.santa_lucia("s", 0.1e-6, 350e-3, 0.0).tm) == pytest.approx(62.7, rel=0.02)
    assert one(spark, "ACGTAGATCTACGT", seq.santa_lucia("s", 0.1e-6, 350e-3, 0.0).tm) == pytest.approx(47.428514, rel=0.02)
    assert one(spark, "GTAAAACGACGGCCAGT", seq.melting_temperature("s")) == pytest.approx(52.8, rel=0.02)
    assert cloning.melting_temperature("GTAAAACGACGGCCAGT") == pytest.approx(one(spark, "GTAAAACGACGGCCAGT", seq.melting_temperature("s")))


def test_barcodes(spark):
    assert design.de_bruijn(4).startswith("AAAATAAAGAAACAATTAATG") and len(design.de_bruijn(4)) == 259
    assert all(len({design.de_bruijn(n)[i : i + n] for i in range(4**n)}) == 4**n for n in (2, 3, 5))
    assert design.barcodes(20, 4)[0] == "AAAATAAAGAAACAATTAAT"
    gc = design.barcodes_gc(20, 4, 0.25, 0.75)
    assert gc[0] == "GAAACAATTAATGAATCAAG" and gc[-1] == "CTCTCGGTCGCTCCGTCCCG"
    banned = design.barcodes(20, 4, banned=["CTCTCGGTCGCTCC"])
    assert all("CTCTCGGTCGCTCC" not in b and revcomp("CTCTCGGTCGCTCC") not in b for b in banned)
    assert [r.barcode for r in design.barcode_table(spark, 20, 4).orderBy("ordinal").collect()] == design.barcodes(20, 4)


def test_seqhash(spark):
    name = lambda s, **kw: one(spark, s, codec.hash_name_column(seq.seqhash_bytes("s", **kw)))
    h = {k: name("TTAGCCCAT", circular=c, double=d) for k, c, d in (("A", True, True), ("B", True, False), ("C", False, True), ("D", False, False))}
    assert all(v.startswith(f"{k}_") for k, v in h.items()) and len(set(h.values())) == 4
    assert name("GCCCATTTA", circular=True, double=True) == h["A"] and name("ATGGGCTAA", double=True) == h["C"]
    assert name("MGC*", kind="PROTEIN").startswith("I_") and name("UUAGCCCAU", kind="RNA").startswith("H_")
    for s, kw in (("XTGGCCTAA", {}), ("MGCJ*", {"kind": "PROTEIN"})):
        with pytest.raises(Exception, match="Only letters"):
            name(s, **kw)
    with pytest.raises(ValueError, match="double stranded"):
        seq.seqhash_bytes("s", kind="PROTEIN", double=True)
    f = one(spark, "ATGGGCTAA", seq.seqhash_fragment_bytes("s", F.lit(4), F.lit(5)))
    assert f == one(spark, revcomp("ATGGGCTAA"), seq.seqhash_fragment_bytes("s", F.lit(5), F.lit(4)))
    flag = one(spark, 0b00101101, seq.decode_flag("s"), "int")
    assert (flag.version, flag.kind, flag.circular, flag.double_stranded) == (2, "RNA", True, True)


def test_base58_and_rotation():
    rng = random.Random(2)
    for _ in range(50):
        b = bytes(rng.choice([0, 0, 7, 255]) for _ in range(rng.randint(0, 20)))
        assert codec.base58_decode(codec.base58_encode(b)) == b
        s = "".join(rng.choice("AB") for _ in range(rng.randint(1, 30)))
        assert codec.least_rotation(s) == min(s[i:] + s[:i] for i in range(len(s)))
    with pytest.raises(ValueError, match="base58"):
        codec.base58_decode("0")
    for bad in ("abc", "A_1"):
        with pytest.raises(ValueError):
            codec.hash_from_name(bad)


def test_svb():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 256, 700), rng.integers(0, 2**32, 700)]).astype(np.uint32)
    c = codec.SvbCodec.from_values(v)
    assert (codec.svb_decode(c.mask, c.data, len(v)) == v).all() and codec.SvbCodec.from_bytes(c.to_bytes()).get(1200) == v[1200] and c.get(513) == v[513]
    s = rng.integers(-32768, 32767, 999).astype(np.int16)
    assert (codec.svb_decompress_signal(999, *codec.svb_compress_signal(s)) == s).all()


def test_random():
    assert codec.random_protein(15, 2)[0] == "M" and codec.random_protein(15, 2)[-1] == "*" and codec.random_dna(9, 1) == codec.random_dna(9, 1) and set(codec.random_rna(99, 3)) == set("ACUG")
    with pytest.raises(ValueError):
        codec.random_protein(2, 1)


@pytest.mark.parametrize(("a", "b", "score"), [("GATTACA", "GCATGCU", 0), ("GATTACA", "GATTACA", 7), ("GATTACA", "GAT", -1), ("", "GAT", -3)])
def test_needleman_wunsch(a, b, score):
    got = align.needleman_wunsch(a, b, full=True)
    assert got[0] == score and got[1].replace("-", "") == a and got[2].replace("-", "") == b


def test_smith_waterman():
    assert align.smith_waterman("GATTACA", "GATTACA")[0] == 7 and align.smith_waterman("AAAA", "TTTT")[0] == 0
    m = align.read_matrix("# x\n   A  C\nA  5 -4\nC -4  5\n", -2)
    assert align.smith_waterman("AACC", "AC", m) == (10, "AC", "AC")
    with pytest.raises(ValueError, match="not in alphabet"):
        align.needleman_wunsch("AG", "A", m)


def test_sketch(spark):
    a, b = "ATGCGATCGATCGATCGATCGATCGA"[:25], "ATGCGATCGATCGATCG"
    va, vb = one(spark, a, seq.sketch("s", 17, 10)), one(spark, b, seq.sketch("s", 17, 5))
    assert len(va) == 10 and vb == [0] * 5 and va[8:] == [0, 0]
    assert align.sketch_similarity([1, 1, 2, 3], [1, 1, 5]) == pytest.approx(2 / 3)


def test_matching(spark):
    rng = random.Random(3)
    t = {f"t{i}": "".join(rng.choice("ACGT") for _ in range(60)) for i in range(3)}
    templates = spark.createDataFrame(list(t.items()), "identifier string, sequence string")
    reads = spark.createDataFrame([(1, revcomp(t["t1"])), (2, t["t0"][:40]), (3, "ACGT")], "read_id long, sequence string")
    got = {(r.read_id, r.identifier): r.score for r in matching.match_templates(reads, templates, 16).collect()}
    assert got[(1, "t1")] == 1.0 and got[(2, "t0")] == pytest.approx(25 / 45) and len(got) == 2
    with pytest.raises(Exception, match="unique kmers"):
        matching.unique_kmer_index(templates.union(templates), 16, least=10).collect()
    j = matching.matches_json(matching.match_templates(reads, templates, 16)).where("read_id = 1").first().megamash
    assert j == '[{"identifier":"t1","score":1.0}]'


def test_digest():
    bsai = cloning.enzyme("BsaI")
    part = "ATATATAGGTCTCAATGCATCGATCGACTAGCATGCATTTGAGACCATATAT"
    f = cloning.digest(part, False, bsai)
    assert len(f) == 1 and f[0].forward_overhang + f[0].sequence + f[0].reverse_overhang == part[14:-13]
    single = cloning.digest("TTTGGTCTCAATGCCCCCCCCCC", False, bsai, directional=False)
    assert single == [("CCCCCCCCC", "ATGC", ""), ("TTTGGTCTCA", "", "ATGC")]
    assert cloning.digest(part.lower(), False, bsai) == f and cloning.digest(part.lower(), False, bsai, methylated=True) == []
    with pytest.raises(ValueError, match="enzyme not found"):
        cloning.enzyme("None")


def test_ligate():
    F_ = cloning.Fragment
    parts = [F_("AAAAAACTA", "GTTG", "TTTT"), F_("TTTTTT"[:3], "TTTT", "GTTG")]
    assert cloning.ligate(parts, True) == ("GTTGAAAAAACTATTTTTTT", [0, 1])
    flipped = [parts[0], F_(revcomp(parts[1].sequence), revcomp(parts[1].reverse_overhang), revcomp(parts[1].forward_overhang))]
    assert cloning.ligate(flipped, True) == ("GTTGAAAAAACTATTTTTTT", [0, 1])
    assert cloning.ligate([F_("A", "GG", "CC")], False) == ("GGACC", [0])
    for bad in ([], [F_("A", "GG", "TT")]):
        with pytest.raises(ValueError):
            cloning.ligate(bad, True)


def test_pcr(spark):
    rng = random.Random(5)
    t = "".join(rng.choice("ACGT") for _ in range(300))
    p = ["TTATAGGTCTCATACT" + t[40:62], "ATGAAGAGACCATATA" + revcomp(t[200:222])]
    assert cloning.amplify([t], 55.0, False, p) == ["TTATAGGTCTCATACT" + t[40:222] + revcomp("ATGAAGAGACCATATA")]
    assert cloning.pcr([t], 55.0, False, p)[1] is None
    around = cloning.amplify([t], 55.0, True, ["TTATAGGTCTCATACT" + t[200:222], "ATGAAGAGACCATATA" + revcomp(t[40:62])])
    assert around == ["TTATAGGTCTCATACT" + t[200:] + t[:62] + revcomp("ATGAAGAGACCATATA")]
    assert cloning.amplify([t], 99.0, False, [t[40:60]]) == []
    d = one(spark, t, seq.design_primers("s", 55.0, "AAAA", "CCCC"))
    assert d.forward.startswith("AAAA" + t[:15]) and d.reverse.startswith("GGGG" + revcomp(t)[:15])


def made_up_fidelity():
    words = [a + b + c + d for a in "ACGT" for b in "ACGT" for c in "ACGT" for d in "ACGT"]
    return {(x, y): 1000 if x == y else (7 * i + 3 * j) % 5 for i, x in enumerate(words) for j, y in enumerate(words)}


def test_fragments(spark):
    fid = made_up_fidelity()
    rng = random.Random(6)
    s = "".join(rng.choice("ACGT") for _ in range(700))
    parts, efficiency = design.fragment(s, 95, 105, fid)
    joined = parts[0] + "".join(p[4:] for p in parts[1:])
    ends = [p[-4:] for p in parts[:-1]]
    assert joined == s and 0 < efficiency <= 1 and len({min(e, revcomp(e)) for e in ends}) == len(ends) and all(len(p) <= 105 for p in parts)
    assert efficiency == pytest.approx(design.set_efficiency([s[:4], s[-4:], *ends], fid))
    for a, b in ((120, 100), (5, 8)):
        with pytest.raises(ValueError):
            design.fragment(s, a, b, fid)
    tree = design.recursive_fragment(s, 100, [3, 4], fid)
    rows = tree.rows()
    assert [r["node"] for r in rows] == list(range(len(rows))) and all(rows[r["parent"]]["level"] == r["level"] - 1 for r in rows[1:])
    with pytest.raises(ValueError, match="too long"):
        design.recursive_fragment(s * 9, 100, [3, 4], fid)
    best = design.next_overhangs(["AATG"], fid)
    assert design.next_overhang(["AATG"], fid) == max(best, key=lambda x: x[1])[0] and "AATG" not in dict(best) and "CATT" not in dict(best)
    sets = spark.createDataFrame([(1, k, w) for k, w in enumerate(["AATG", "GCTT", "TTTT"])], "set_id long, ordinal int, overhang string")
    table = spark.createDataFrame([(x, y, n) for (x, y), n in fid.items() if x in ("AATG", "GCTT", "TTTT")], "x string, y string, n long")
    assert design.set_efficiency_native(sets, table).first().efficiency == pytest.approx(design.set_efficiency(["AATG", "GCTT", "TTTT"], fid))


def test_codons(spark):
    t1 = codons.codon_tables(spark, 1)
    known = codons.translation_map(11)
    gfp = "ATGGCTAGCAAAGGAGAAGAACTTTTCACTGGAGTTGTCCCAATTCTTGTTGAATTAGATGGTGATGTTAATGGGCACAAATTTTCTTAA"
    assert one(spark, gfp.lower() + "AT", seq.translate("s", known)) == "MASKGEELFTGVVPILVELDGDVNGHKFS*"
    genes = spark.createDataFrame([(gfp,), ("ATGA",)], "sequence string")
    w = codons.weighted(t1, genes)
    assert w.where("triplet = 'ATG'").first().weight == 1 and w.agg(F.sum("weight")).first()[0] == len(gfp) // 3
    assert codons.start_codons(genes).first().n == 1
    assert codons.added(w, w).where("triplet = 'GAA'").first().weight == 2 * w.where("triplet = 'GAA'").first().weight
    c = {r.triplet: r.weight for r in codons.compromise(w, t1, 0.1).collect()}
    assert c["ATG"] == 10000 and c["GAA"] > 0
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError, match="cut off"):
            codons.compromise(w, w, bad)
    js = codons.codon_json(w)
    back = codons.parse_codon_json(js, "json", 1)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, w.collect()))
    table = design.as_codons(t1)
    dna = design.optimize("MASKGEEL*", table, 5)
    assert one(spark, dna, seq.translate("s", codons.translation_map(1))) == "MASKGEEL*" and dna == design.optimize("MASKGEEL*", table, 5) and dna != design.optimize("MASKGEEL*", table, 6)
    for bad in ("", "J"):
        with pytest.raises(ValueError):
            design.optimize(bad, table, 1)


def test_repair(spark):
    table = design.as_codons(codons.codon_tables(spark, 1))
    known = codons.translation_map(1)
    protein = lambda s: "".join(known[s[i : i + 3]] for i in range(0, len(s), 3))
    s = "ATGAAAAAAAAAAGAAGACGGTCTCTG" + "GCAGCAGCAGCAGCAGCAGCAGCA" + "TAA"
    fixed, changes = design.repair(s, table, design.simple_checks(["GAAGAC", "GGTCTC"]))
    assert protein(fixed) == protein(s) and changes and all(not check(fixed) for check in design.simple_checks(["GAAGAC", "GGTCTC"]))
    rich = "ATG" + "GGC" * 40
    assert design.gc_share(design.repair(rich, table, [design.keep_gc(0.8, 0.2)])[0]) <= 0.8
    with pytest.raises(ValueError, match="complete CDS"):
        design.repair("ATGA", table, [])
    with pytest.raises(ValueError, match="incomplete codon table"):
        design.repair("ATG", {"M": [("ATG", 0)]}, [])
    with pytest.raises(ValueError, match="Too many fixes"):
        design.repair("ATGATGATG", table, [design.remove_sequences(["ATGATG"], "x")])
    with pytest.raises(ValueError, match="Invalid bias"):
        design.repair("ATG", table, [lambda s: [design.Suggestion(0, 0, "XX", 1, "")]])


def test_mutations(spark):
    call = lambda r, ratio=0.5: one(spark, r, pileups.call_mutation("s", F.lit("G"), ratio), "array<string>")
    assert (call(["A", "a", "^].", "."]).type, call(["A", "a", "."]).to) == ("point", "A")
    d = call(["-2AG", "-2AG", "."])
    assert (d.type, d.to, d.length, d.total_mutated) == ("indel", "-2AG", -2, 2)
    assert call(["+1A", "+1A"]).length == 1 and call(["*", "*", "."]).type == "point_indel"
    assert call(["A", "T", "C", "."]).type == "noisy" and call([".", ",", "A"]).type == "no_mutation" and call([]).type == "no_mutation"


def test_dual_barcodes(spark):
    words = [design.de_bruijn(6)[40 * i : 40 * i + 24] for i in range(4)]
    p = barcoding.PrimerSet([("A1", words[0], words[2]), ("A2", words[1], words[3])])
    f, r = "GTTTTCCCAGTCACGAC", "AGCGGATAACAATTTCACACAGG"
    body = codec.random_dna(400, 1)
    read = words[1] + f + body + revcomp(words[3] + r)
    assert barcoding.well(read, f, r, p) == "A2" and barcoding.well(revcomp(read), f, r, p) == "A2" and barcoding.well(read.lower(), f, r, p) == "A2"
    assert barcoding.well(read[:150], f, r, p) == "" and barcoding.well(words[1] + f + body, f, r, p) == ""
    table = spark.createDataFrame([("A1", words[0], words[2]), ("A2", words[1], words[3])], "name string, forward string, reverse string")
    reads = spark.createDataFrame([("x", {"k": "v"}, read)], "identifier string, optionals map<string,string>, sequence string")
    assert barcoding.with_barcode(reads, table, f, r).first().optionals == {"k": "v", "dual_barcode": "A2"}


def test_stream_equals_batch(spark, tmp_path):
    from helixlake.sources import register
    from helixlake.streaming import filtered, with_megamash

    register(spark)
    t = codec.random_dna(80, 4)
    templates = spark.createDataFrame([("t", t), ("u", codec.random_dna(80, 5))], "identifier string, sequence string")
    for k in range(3):
        (tmp_path / f"{k}.fastq").write_text(f"@r{k} ch={k}\n{t[k * 5 : k * 5 + 60]}\n+\n{'I' * 60}\n")
    stage = lambda df: with_megamash(filtered(df, F.length("sequence") > 10), templates)
    batch = stage(spark.read.format("fastq").load(str(tmp_path)))
    q = stage(spark.readStream.format("fastq").load(str(tmp_path))).writeStream.format("memory").queryName("mega").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "_cp")).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("mega").collect())) == sorted(map(str, batch.collect()))
    assert batch.first().optionals["megamash"].startswith('[{"identifier":"t"')
