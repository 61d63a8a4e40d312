import math
import random
import re
import unicodedata

from lodestrand.operators import rejects

MISSING = {"", "na", "nan", "null", "none", "n/a"}


def csv_fields(line):
    """Fields of a record by a character automaton, None where quoting is broken."""
    fields, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            i, out = i + 1, []
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        out.append('"')
                        i += 2
                        continue
                    i += 1
                    break
                out.append(line[i])
                i += 1
            if i < len(line) and line[i] != ",":
                return None
            fields.append("".join(out))
        else:
            end = line.find(",", i)
            end = len(line) if end < 0 else end
            if '"' in line[i:end]:
                return None
            fields.append(line[i:end])
            i = end
        if i >= len(line):
            return fields
        i += 1


def bad_id(text):
    return not text or any(c.isspace() or unicodedata.category(c)[0] == "C" for c in text)


def good_value(text):
    text = text.strip()
    return text.lower() in MISSING or (re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text) and math.isfinite(float(text)))


def csv_reason(line, width):
    fields = csv_fields(line)
    if fields is None:
        return "quoting"
    if all(not f.strip() for f in fields):
        return "skip"
    if len(fields) != width:
        return "column_count"
    if bad_id(fields[0]) or bad_id(fields[1]):
        return "identifier"
    return None if all(map(good_value, fields[2:])) else "value"


def test_csv_against_automaton(spark):
    rng = random.Random(7)
    parts = ['"', '""', ",", ",", "a", "b1", "1", "-2.5e3", ".5", "5.", "1e999", "NA", "n/a", " ", "\t", " ", "​", "\n", "é", "1d", "0x1", "NaN", "Infinity", "\\", "'", "﻿"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(3_000)]
    lines += [f"f{i},i{i},{rng.choice(parts)},{rng.choice(parts)}" for i in range(1_000)]
    lines += ['f,i,"' + '""x' * 20_000 + '",1', "f,i," + "9" * 5_000 + ",1", "," * 3, '"","",""', "x" * 200_000 + ",i,1,2", '"' + "a" * 100_000]
    rows = [("f.csv", "csv", 1, '﻿"FID",IID,"a, b",c')] + [("f.csv", "csv", n, line) for n, line in enumerate(lines, 2)]
    df = spark.createDataFrame([*rows, rows[5], ("f.csv", "csv", 9_000_000, None)], "file_name string, kind string, line_no int, line string")
    judged = {r["line_no"]: r for r in rejects.classify_lines(df).collect()}
    assert rejects.split_lines(df)[1].filter("line_no = 6").count() <= 1
    for n, line in enumerate(lines, 2):
        want = csv_reason(line, 4)
        got = judged[n]["reason"] if n in judged else "skip"
        assert got == want, (line[:200], got, want)
        if want is None:
            fields = csv_fields(line)
            assert [judged[n]["fid"], judged[n]["iid"]] == fields[:2]
            assert judged[n]["values"] == [None if f.strip().lower() in MISSING else float(f) for f in fields[2:]]
    assert 9_000_000 not in judged


def test_fam_and_files_without_header(spark):
    rows = [("a.fam", "fam", i, line) for i, line in enumerate(["0 1 0 0 1 2", " 0\t1 \t0 0 1 2 ", "0 1 0 0 1", "", None, "0 1 2 0 0 1 x", "​ 1 0 0 1 x", "   "])]
    rows += [("b.csv", "csv", 2, "f,i,1"), ("b.csv", "csv", 3, "f,,1"), ("c.txt", "other", 1, "x")]
    got = {(r["file_name"], r["line_no"]): r["reason"] for r in rejects.classify_lines(spark.createDataFrame(rows, "file_name string, kind string, line_no int, line string")).collect()}
    assert [got["a.fam", i] for i in range(8)] == [None, None, "column_count", "column_count", "column_count", "identifier", "identifier", "column_count"]
    assert got["b.csv", 2] is None and got["b.csv", 3] == "identifier" and ("c.txt", 1) not in got


def test_empty_table(spark):
    loaded, rejected = rejects.split_lines(spark.createDataFrame([], "file_name string, kind string, line_no int, line string"))
    assert loaded.collect() == [] and rejected.collect() == []
