from compare import rows_of, rows_of_sql
from texts import empty, odd, with_clashes

from larkspur.llm.licenses import LICENSES, ORACLES, op2_license_scan, registry, scan


def test_matches_sql(spark, sf, duck):
    assert rows_of(op2_license_scan(spark, sf)) == rows_of_sql(duck, ORACLES["op2_license_scan"])


def test_forms(spark):
    mit = LICENSES[0][1]
    varied = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", " ,")
    rows = [(1, varied), (2, mit + " more"), (3, "x\nReleased under the MIT licence\ny"), (4, "Some text.\n\n" + LICENSES[1][1].split("\n")[0]), (5, "a licence of another kind"), (6, None)]
    found = {(r.doc_id, r.license_id, r.scope) for r in scan(with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (1, "MIT", "document") in found and (3, "MIT", "line") in found
    assert not {d for d, _, _ in found} & {2, 4, 5, 6}


def test_every_entry_finds_itself(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(LICENSES)], "doc_id long, text string")
    found = {(r.doc_id, r.license_id) for r in scan(docs).where("scope = 'document'").collect()}
    assert found == {(i, k) for i, (k, _) in enumerate(LICENSES)}


def test_odd_rows(spark):
    assert scan(with_clashes(odd(spark))).count() == 0 and scan(empty(spark)).count() == 0


def test_no_word_is_needed(spark):
    """Wrapped and spaced notices match, and entries of any words."""
    rows = [(1, "All rights\nreserved."), (2, "All rights-reserved"), (3, "Released\nunder CC0 1.0."), (4, "x\n\nReleased  under\nCC0 1.0\n\ny")]
    found = {(r.doc_id, r.license_id, r.scope) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, "all-rights-reserved", "document"), (2, "all-rights-reserved", "document"), (3, "CC0-1.0", "document"), (4, "CC0-1.0", "paragraph")}
    own = registry(spark, [("WTFPL", "Do what you want to.")])
    assert [r.license_id for r in scan(spark.createDataFrame([(1, "do what\nyou want to")], "doc_id long, text string"), own).collect()] == ["WTFPL"]


def test_licence_files(spark):
    """Files as they stand in packages: a title, a copyright line, the text."""
    from larkspur.llm.licenses import TITLES

    of = {}
    for k, t in LICENSES:
        of.setdefault(k, t)
    rows = [(i, f"{title}\n\nCopyright (c) 2020-2024 Some One\n\n{of[k]}\n", k) for i, (k, title) in enumerate((k, t) for k, own in TITLES.items() for t in own)]
    found = {(r.doc_id, r.license_id) for r in scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).where("scope = 'document'").collect()}
    assert found == {(i, k) for i, _, k in rows}


def test_long_licences(spark):
    """The digests, against the texts that the system holds."""
    import os

    from larkspur.llm.licenses import DIGESTS

    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    assert set(files) <= {k for k, _ in DIGESTS}
    rows = [(k, open(f"{folder}/{f}", encoding="utf-8").read()) for k, f in files.items() if os.path.exists(f"{folder}/{f}")]
    docs = spark.createDataFrame([(i, t.replace("\n", "\r\n").replace("LICENSE", "Licence")) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {(r.doc_id, r.license_id) for r in scan(docs).where("scope = 'document'").collect()}
    assert found == {(i, k) for i, (k, _) in enumerate(rows)}
