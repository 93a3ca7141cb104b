import random

import pytest

from strandline.operators.parse_rows import valid_rows
from strandline.sources import records, text
from tests.test_skew_profile_parse import line


def plain(content):
    """Records of one text, read from front to back."""
    lines = content.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    out, i = [], 0
    while i < len(lines):
        if records.opens(lines[i]):
            end = None
            for j in range(i + 1, len(lines)):
                goes = records.after_open(lines[j])
                if goes == records.After.CLOSED:
                    end = j
                if goes != records.After.OPEN:
                    break
            if end is not None:
                out.append((i, "\n".join(lines[i : end + 1])))
                i = end + 1
                continue
        out.append((i, lines[i]))
        i += 1
    return out


def test_line_states():
    assert records.opens('a\t"b') and records.opens('"b ""x""') and not records.opens('a"b') and not records.opens('a\t"b"\tc') and not records.opens("a")
    assert [records.after_open(x) for x in ("text", 'end"', 'end"\tb\t"c"', 'x"\ty\t"z', 'bad"x', 'a "" b', '"\tb"c')] == [0, 1, 1, 0, 2, 0, 2]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_records_over_block_borders(spark, tmp_path, size):
    rng = random.Random(6)
    pieces = ['a\tb', '"x\ty"', 'p\t"open', 'still "" open', 'end"\tq', '"', 'bad"x', "", 'r\t"s"\t"t', "plain text", 'u"']
    contents = {f"f{k}.tsv": "\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) + rng.choice(["", "\n"]) for k in range(6)}
    contents["g.tsv"] = 'h\t"long\n' + "no quote here\n" * 30 + 'over many blocks"\tz\nnext\n'
    contents["h.tsv"] = 'h\t"never closed\n' + "no quote here\n" * 20
    for name, content in contents.items():
        (tmp_path / name).write_text(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {}
        for r in records.records(spark, [str(tmp_path)]).collect():
            got.setdefault(r["file_name"].rsplit("/", 1)[1], []).append((r["line_no"], r["line_text"]))
        numbers = sorted((r["file_name"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in records.numbered_lines(spark, [str(tmp_path)]).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    base, lines = 0, []
    for name in sorted(contents):
        want = plain(contents[name])
        assert sorted(got.get(name, [])) == [(base + i, t) for i, t in want], name
        n = len(contents[name].removesuffix("\n").split("\n")) if contents[name] else 0
        lines += [(name, base + i, x) for i, x in enumerate(contents[name].removesuffix("\n").split("\n"))]
        base += n
    assert numbers == lines


def test_feature_record_with_line_break(spark, tmp_path):
    (tmp_path / "x.tsv").write_text(line() + "\n" + line(c4='"read\none ""two"""') + "\n" + line(c4='"open') + "\n" + line() + "\n")
    parsed = valid_rows(text.read_feature_lines(spark, [str(tmp_path / "x.tsv")])).collect()
    assert sorted(r["readname"] for r in parsed) == ["read", "read", 'read\none "two"']
