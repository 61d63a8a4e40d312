import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import identity, masks
from lodestrand.plans import workflow
from lodestrand.sources import files, plink

PEOPLE = [("0", "p-1"), ("0", "p-2"), ("fam7", "p-1"), ("fam7", "kid"), ("0", "Ö3"), ("x.y", "9"), ("x.y", "10"), ("0", "last"), ("fam7", "aunt")]
N = len(PEOPLE)
BASES = "ACGT"
MAPPING = {"chrom": "chr", "pos": "bp", "a1": "first", "a2": "second", "CADD": "score", "qc": "filter", "category": "region", "exonic": "effect", "info": "names", "metasvm": "call", "genehancer": "enh", "cage": "c", "dhs": "d"}
MANIFEST = {"column_mapping": MAPPING, "annotation_catalog": {"CADD": "a/b"}, "annotation_names": ["CADD"], "qc_path": "a/qc"}


def pack(codes):
    out = bytearray(plink.HEADER)
    for row in codes:
        padded = [*row, *[0] * (-len(row) % 4)]
        out += bytes(sum(int(c) << 2 * k for k, c in enumerate(padded[i : i + 4])) for i in range(0, len(padded), 4))
    return bytes(out)


def chromosome(where, chrom, n_variants, seed):
    """Writes one chromosome's files; returns its codes and the lines of its variants."""
    rng = np.random.default_rng(seed)
    codes = rng.choice([0, 1, 2, 3], (n_variants, N), p=[0.1, 0.05, 0.25, 0.6])
    place = [1_000 * seed + 37 * (j // 2 * 2) for j in range(n_variants)]
    lines = [(place[j], BASES[j % 4], BASES[(j + 1 + j // 4) % 4] if (j + 1 + j // 4) % 4 != j % 4 else BASES[(j + 2) % 4]) for j in range(n_variants)]
    (where / f"c{chrom}.fam").write_text("".join(f"{f}\t{i} 0 0 2 -9\n" for f, i in PEOPLE), encoding="utf-8")
    (where / f"c{chrom}.bim").write_text("".join(f"{chrom} v{j} 0 {pos} {alt} {ref}\n" for j, (pos, ref, alt) in enumerate(lines)))
    (where / f"c{chrom}.bed").write_bytes(pack(codes))
    text = ",".join(MAPPING.values()) + "\n"
    for j, (pos, ref, alt) in enumerate(lines):
        a, b = (alt, ref) if j % 3 == 0 else (ref, alt)
        text += f"chr{chrom},{pos},{a},{b},{'' if j % 5 == 2 else j / 4},{'FAIL' if j % 7 == 6 else 'PASS'},{'upstream' if j % 2 else 'exonic'},{'nonsynonymous SNV' if j % 3 else 'synonymous SNV'},{'SAME' if j < n_variants // 2 else 'TAIL'},{'D' if j % 4 == 1 else 'T'},,,\n"
    (where / f"a{chrom}.csv").write_text(text + f"chr{chrom},1,A,T,7,PASS,exonic,,NONE,,,,\n")
    return codes, lines


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    where = tmp_path_factory.mktemp("study")
    made = {chrom: chromosome(where, chrom, n, seed) for chrom, n, seed in (("5", 12, 1), ("11", 10, 2))}
    (where / "m.json").write_text(json.dumps(MANIFEST))
    span = {c: (lines[0][0], lines[len(lines) // 2][0], lines[-1][0]) for c, (_, lines) in made.items()}
    genes = [f"TAIL,{c},{middle}.0,{high}\nSAME,chr{c},{low},{middle}" for c, (low, middle, high) in span.items()]
    (where / "genes.csv").write_text("hgnc_symbol,chromosome_name,start_position,end_position\n" + "\n".join(genes) + "\n")
    (where / "rna.csv").write_text("chr,ncRNA\n5,LINC\nchr11,MIR\n5,ANTI\n")
    (where / "promoters.tsv").write_text("# made up\nchromosome\tstart\tend\n5\t3\t9\nchr11\t20\t40\n")
    rng = np.random.default_rng(11)
    (where / "y.csv").write_text("FID,IID,grip,bone,case\n" + "".join(f"{f},{i},{rng.normal():.6f},{rng.normal():.6f},{k % 2}\n" for k, (f, i) in enumerate(PEOPLE)), encoding="utf-8")
    (where / "x.csv").write_text("FID,IID,age,one\n" + "".join(f"{f},{i},{rng.normal():.6f},1\n" for f, i in PEOPLE), encoding="utf-8")
    return where, made


def states(codes, reference_is_a1=False):
    return [[plink.STATES[reference_is_a1][c] for c in row] for row in codes]


def states_of(df, n_variants, n_samples, first=0):
    out = np.zeros((n_variants, n_samples), int)
    for r in df.collect():
        out[r["variant_idx"] - first, r["sample_idx"]] = r["state"]
    return out.tolist()


def test_bed_states_and_errors(spark, study, tmp_path, monkeypatch):
    where, made = study
    path, codes = str(where / "c5.bed"), made["5"][0]
    # Codes 0 and 3 are the two homozygous calls, 1 is missing, 2 heterozygous.
    by_hand = np.select([codes == 0, codes == 1, codes == 2], [2, 3, 1], 0).tolist()
    assert states_of(plink.read_bed(spark, path, N, 12), 12, N) == states(codes) == by_hand
    monkeypatch.setattr(plink, "PART_BYTES", 4)
    assert states_of(plink.read_bed(spark, path, N, 12, reference_is_a1=True), 12, N) == states(codes, True)
    picked = plink.select_calls(plink.read_bed(spark, path, N, 12), spark.createDataFrame([(8, 0), (0, 1)], "sample_idx bigint, new_idx bigint"), spark.createDataFrame([(11, 0), (3, 1), (4, 2)], "variant_idx bigint, new_idx bigint"))
    assert states_of(picked, 3, 2) == [[by_hand[v][s] for s in (8, 0)] for v in (11, 3, 4)]
    good = pack(codes)
    for content, match in ((b"abc" + good[3:], "BED"), (good[:-1], "size"), (good[:-1] + b"\xf0", "bits")):
        (tmp_path / "bad.bed").write_bytes(content)
        with pytest.raises(Exception, match=match):
            plink.read_bed(spark, str(tmp_path / "bad.bed"), N, 12).collect()


def test_bim_and_fam_problems(spark, tmp_path):
    lines = ["7 r 0 500 G T", "8 r 0 501 G T", "7 r 0 -3 G T", "7 r 0 502 G G", "7 r 0 499 G T", "7 7:777:T:G 0 777 G T", "7 chr7:777:G:T 0 777 G T", "7 r 0", "7 r 0 5e2 G T", "7 r 0 800 G *"]
    (tmp_path / "b.bim").write_text("\n".join(lines) + "\n")
    got = {r["variant_idx"]: r["problem"] for r in plink.read_bim(spark, str(tmp_path / "b.bim"), "7").collect()}
    assert got == {0: None, 1: "chromosome", 2: "position", 3: "alleles", 4: "order", 5: None, 6: "identity", 7: "column_count", 8: "position", 9: "alleles"}
    (tmp_path / "b.fam").write_text("f i 0 0 1 2\nf i 0 0 1\nf⁠ i 0 0 1 2\n")
    assert [r["problem"] for r in plink.read_fam(spark, str(tmp_path / "b.fam")).orderBy("sample_idx").collect()] == [None, "column_count", "identifier"]


def test_annotation_formats(spark, study, tmp_path):
    mapping = {"pos": "bp", "score": "score"}
    text = (study[0] / "a5.csv").read_text()
    head, *rest = [line.split(",") for line in text.splitlines()]
    want = [(r[head.index("bp")], r[head.index("score")] or None) for r in rest]
    (tmp_path / "a.csv").write_text(text)
    assert [tuple(r) for r in files.read_annotations(spark, str(tmp_path / "a.csv"), mapping).collect()] == want
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as archive:
        for name, content in (("in/a.csv", text), ("in/b.csv", "bp,score\n1,1\n")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content.encode()))
    assert [tuple(r) for r in files.read_annotations(spark, str(tmp_path / "a.tar.gz"), mapping, "in/a.csv").collect()] == want
    (tmp_path / "a.tsv").write_text(text.replace(",", "\t"))
    assert [tuple(r) for r in files.read_annotations(spark, str(tmp_path / "a.tsv"), mapping).collect()] == want
    spark.read.csv(str(tmp_path / "a.csv"), header=True).coalesce(1).write.parquet(str(tmp_path / "a.parquet"))
    assert [tuple(r) for r in files.read_annotations(spark, str(tmp_path / "a.parquet"), mapping).collect()] == want


def test_archive_is_streamed_not_loaded(spark, tmp_path):
    place = tmp_path / "a b%20c.tar.gz"
    text = "POS,WEIGHT\n" + "".join(f"{i},{i * i}\n" for i in range(2000))
    with tarfile.open(place, "w:gz") as archive:
        info = tarfile.TarInfo("x.csv")
        info.size = len(text)
        archive.addfile(info, io.BytesIO(text.encode()))
    setting = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(setting, "100")
    try:
        got = [tuple(r) for r in files._read_tar(spark, str(place), None, {"pos": "POS", "score": "WEIGHT"}).collect()]
    finally:
        spark.conf.unset(setting)
    assert got == [(str(i), str(i * i)) for i in range(2000)]


def test_references_and_manifest(spark, study, tmp_path):
    where, made = study
    low, middle, high = (made["5"][1][j][0] for j in (0, 6, 11))
    genes = files.read_genes(spark, str(where / "genes.csv"), "5").orderBy("ordinal").collect()
    assert [(g["gene_name"], g["start_pos"], g["end_pos"], g["problem"]) for g in genes] == [("TAIL", middle, high, None), ("SAME", low, middle, None)]
    (tmp_path / "g.csv").write_text("hgnc_symbol,chromosome_name,start_position,end_position\n,5,1,2\nA,5,3,2\nB,5,1.5,2\nC,5,0,2\n")
    assert [g["problem"] for g in files.read_genes(spark, str(tmp_path / "g.csv"), "5").orderBy("ordinal").collect()] == ["name", "position", "position", "position"]
    assert [r["gene_name"] for r in files.read_ncrnas(spark, str(where / "rna.csv"), "5").orderBy("ordinal").collect()] == ["LINC", "ANTI"]
    assert sorted(map(tuple, files.read_promoters(spark, str(where / "promoters.tsv")).collect())) == [("11", 20, 40), ("5", 3, 9)]
    (tmp_path / "p.json").write_text('[["Chr5", 3, 9], ["11", 20, 40]]')
    assert sorted(map(tuple, files.read_promoters(spark, str(tmp_path / "p.json")).collect())) == [("11", 20, 40), ("5", 3, 9)]
    (tmp_path / "m2.json").write_text(json.dumps(MANIFEST | {"chromosomes": {"11": {"default_qc": "X"}}}))
    assert "default_qc" not in files.read_manifest(str(tmp_path / "m2.json"), "5") and files.read_manifest(str(tmp_path / "m2.json"), "11")["default_qc"] == "X"
    (tmp_path / "m3.json").write_text(json.dumps(MANIFEST | {"annotation_names": ["none"]}))
    with pytest.raises(ValueError, match="unknown"):
        files.read_manifest(str(tmp_path / "m3.json"), "5")


def test_trait_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿IID,FID,grip,crp\nb1,u,2.5,none\nb1,v,-3,1e2\n\nb2,u,?,8\nb3,u,,.5\nb4,u,11\nb5,u,inf,1\n", encoding="utf-8")
    loaded, rejected = files.read_traits(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, loaded.collect()), key=str) == sorted([("u", "b1", 2.5, None), ("v", "b1", -3.0, 100.0), ("u", "b3", None, 0.5)], key=str)
    assert sorted((r["line_no"], r["reason"]) for r in rejected.collect()) == [(5, "value"), (7, "column_count"), (8, "value")]
    (tmp_path / "l.csv").write_text("eid,bmi\n52,21.700000000000003\n53,\n054,3\n55,5\n55,6\n56,thin\n")
    good, bad = files.read_legacy(spark, str(tmp_path / "l.csv"), ["bmi"])
    assert {(r["eid"], r["problem"]) for r in bad.collect()} == {("054", "identifier"), ("55", "repeated"), ("56", "value")}
    assert sorted(map(tuple, good.collect())) == [(52, 21.700000000000003), (53, None)]
    (tmp_path / "pr.csv").write_text("phenotype,model_family,profile,covariate_columns\nasthma,binomial,full,age;sex;\n")
    assert files.read_profiles(spark, str(tmp_path / "pr.csv")).first()["covariates"] == ["age", "sex"]


def test_mask_tokens(spark):
    rows = [
        (0, 5, "PASS", "upstream", "K1,K2", "", "", ""),
        (1, 15, "PASS", "downstream", "K2", "", "", ""),
        (2, 25, "PASS", "UTR5", "K1(NM_1:c.5)", "p=q=r=K3;rest", "x", ""),
        (3, 35, "PASS", "ncRNA_exonic;splicing", "K1,K2,K3,K4(d);K5", "", "", "x"),
        (4, 45, "PASS", "intergenic", "K2-dist=7", "p=q=r=K1", "", "x"),
        (5, 55, "LOW", "UTR3", "K1", "p=q=r=K1", "x", "x"),
    ]
    schema = "variant_idx bigint, pos bigint, qc string, category string, info string, genehancer string, cage string, dhs string, ref string, alt string, chrom string"
    variants = spark.createDataFrame([(*r, "A", "G", "3") for r in rows], schema)
    intervals = spark.createDataFrame([("3", 20, 30), ("3", 28, 50), ("4", 1, 60)], "chrom string, start_pos bigint, end_pos bigint")
    got = {}
    for r in masks.gene_tokens(variants, intervals).collect():
        got.setdefault((r["gene_name"], r["mask"]), set()).add(r["variant_idx"])
    want = {("K1", "upstream"): {0}, ("K2", "upstream"): {0}, ("K2", "downstream"): {1}, ("K1", "UTR"): {2}, ("K3", "enhancer_CAGE"): {2}, ("K1", "enhancer_DHS"): {4}, ("K1", "promoter_CAGE"): {2}, ("K1", "promoter_DHS"): {3}, ("K2", "promoter_DHS"): {4}}
    assert got == want | {(k, "ncRNA"): {3} for k in ("K1", "K2", "K3")}
    elsewhere = spark.createDataFrame([("K1", "4"), ("K2", "3")], "gene_name string, chrom string")
    assert {r["gene_name"] for r in masks.noncoding_masks(variants, intervals, elsewhere).collect()} == {"K2"}


def test_promoters_from_transcripts(spark):
    tx = spark.createDataFrame([(1, "chr2", "+", 20_000, 20_400), (2, "chr2", "+", 19_500, 20_100), (3, "chr2", "-", 7_000, 7_700), (4, "chr2", "+", 1, 2), (5, "chr9", "+", 1, 2), (6, "chrX", "+", 40, 90), (7, "chrX", "-", 40, 90), (8, "chrX", "+", 10, 20)], "tx_id int, chrom string, strand string, tx_start bigint, tx_end bigint")
    genes = spark.createDataFrame([("fwd", 1), ("fwd", 2), ("rev", 3), ("two_places", 4), ("two_places", 5), ("two_strands", 6), ("two_strands", 7), ("edge", 8)], "gene_id string, tx_id int")
    got = {r["gene_id"]: (r["start_pos"], r["end_pos"]) for r in masks.promoters_from_transcripts(tx, genes, 1_000, 500).collect()}
    assert got == {"fwd": (18_500, 19_999), "rev": (7_201, 8_700), "edge": (-990, 509)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1e-300, True, 2), ("a", float("nan"), False, 1), ("c", float("-inf"), None, 0), (None, -0.0, True, 4), ("d", 0.1, None, 3)], "k string, p double, f boolean, _at int")
    files.write_results(df, str(tmp_path / "r"), [F.col("_at")], single_file=True)
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv"))
    assert text == f"k,p,f\nc,-Inf,\na,NaN,FALSE\nb,{1e-300:.17g},TRUE\nd,{0.1:.17g},\n,-0,TRUE\n"
    files.write_results(df.filter("false"), str(tmp_path / "e"), ["k"])
    assert "".join(p.read_text() for p in (tmp_path / "e").glob("*.csv")) == "k,p,f\n"
    files.write_shards(df, str(tmp_path / "s"), ["f"], rows_per_file=1)
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 5


def test_union_in_order(spark):
    first = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2)], "k string, at int")
    second = spark.createDataFrame([("c", 0), ("a", 1)], "k string, at int")
    assert [r["k"] for r in identity.union_in_order(first, second, "k", "at").orderBy("ordinal").collect()] == ["b", "a", "c"]


def prepare(spark, where, chroms, output, genes="genes.csv"):
    workflow.prepare(spark, {c: str(where / f"c{c}") for c in chroms}, str(where / "m.json"), {c: str(where / f"a{c}.csv") for c in chroms}, str(where / genes), str(where / "rna.csv"), str(where / "promoters.tsv"), str(output))


def test_two_chromosomes_equal_separate_runs(spark, study, tmp_path):
    where, made = study
    rows = {}
    for name, chroms in (("both", ("5", "11")), ("only5", ("5",)), ("only11", ("11",))):
        prepare(spark, where, chroms, tmp_path / name)
        out = str(tmp_path / f"{name}-results")
        args = dict(analyses=("single", "coding"), traits={"grip": ["age", "one"], "bone": ["age", "one"], "case": ["age"]}, joint_groups=[("grip", "bone")], annotation_names=["CADD"], mac_cutoff=1, rare_maf_cutoff=0.6)
        report = workflow.run_all(spark, str(where / "y.csv"), str(where / "x.csv"), str(tmp_path / name), out, **args)
        assert report["traits"] == {"grip": "gaussian", "bone": "gaussian", "case": "binomial"}
        rows[name] = {kind: spark.read.csv(f"{out}/{kind}", header=True).drop("variant_idx").collect() for kind in report["rows"]}
        if name == "both":
            data = workflow.Dataset(spark, str(tmp_path / name))
            numbers = {c: sorted(r["variant_idx"] for r in data.variants.filter(F.col("chrom") == c).collect()) for c in chroms}
            assert numbers == {"11": list(range(10)), "5": list(range(10, 22))}
            assert states_of(data.calls.filter("chrom = '5'"), 12, N, 10) == states(made["5"][0])
            assert workflow.run_all(spark, str(where / "y.csv"), str(where / "x.csv"), str(tmp_path / name), out, **args) == report
            with pytest.raises(ValueError, match="other inputs"):
                workflow.run_all(spark, str(where / "y.csv"), str(where / "x.csv"), str(tmp_path / name), out, **(args | {"mac_cutoff": 2}))
    close = lambda r: tuple(f"{float(v):.9g}" if v and v.replace(".", "").replace("e-", "").replace("-", "").isdigit() else v for v in r)
    assert {"single", "single_joint", "coding", "coding_joint", "coding_binary", "coding_binary_summaries"} == set(rows["both"])
    assert {r["trait"] for r in rows["both"]["coding_joint"]} == {"grip+bone"}
    for kind, both in rows["both"].items():
        apart = rows["only5"][kind] + rows["only11"][kind]
        assert sorted(map(str, map(close, both))) == sorted(map(str, map(close, apart))), kind
    coding = [r for r in rows["both"]["coding"] if r["trait"] == "grip"]
    assert {(r["Chr"], r["Gene name"]) for r in coding} == {("5", "TAIL"), ("5", "SAME"), ("11", "TAIL"), ("11", "SAME")}
    order = [(r["Chr"], r["Gene name"]) for r in coding]
    assert order == sorted(order, key=lambda x: (int(x[0]), x[1] != "TAIL"))


def test_refused_studies(spark, study, tmp_path):
    where, _ = study
    (where / "bad_genes.csv").write_text("hgnc_symbol,chromosome_name,start_position,end_position\nA,5,9,2\n")
    with pytest.raises(ValueError, match="bad_genes"):
        prepare(spark, where, ("5",), tmp_path / "p", "bad_genes.csv")
    with pytest.raises(ValueError, match="no complete dataset"):
        workflow.Dataset(spark, str(tmp_path / "p"))
    text = (where / "a11.csv").read_text().splitlines()
    (where / "a11.csv").write_text("\n".join(text[:1] + text[2:]) + "\n")
    try:
        with pytest.raises(ValueError, match="missing"):
            prepare(spark, where, ("11",), tmp_path / "q")
    finally:
        (where / "a11.csv").write_text("\n".join(text) + "\n")
