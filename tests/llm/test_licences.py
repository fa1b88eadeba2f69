from tonelake.llm.licences import TEMPLATES, scan_licences, template_grams


def test_texts_paragraphs_and_lines(spark):
    mit = TEMPLATES["MIT"]
    wrapped = "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60))
    rows = [
        (1, mit.upper()),
        (2, "Words before.\n\n" + mit.replace(". ", ".\n") + "\n\nand words after " * 40),
        (3, "a text\nReleased under the MIT license\nends"),
        (4, "Released under no license at all"),
        (5, wrapped),
    ]
    got = {r["doc_id"]: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 6)] == ["MIT", "MIT", "MIT notice", None, "MIT"]
    assert got[1]["dice"] == 1.0 and got[4]["dice"] is None and got[4]["n_units"] == 0


def test_dice_against_plain_python(spark):
    rows = [(i, " ".join(["all", "rights", "reserved", "by", "us", "now"][: i + 1])) for i in range(6)]
    got = {r["doc_id"]: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.5).collect()}
    grams = set(template_grams()["all rights reserved"])
    for i, text in rows:
        words = text.split()
        own = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
        dice = 2 * len(own & grams) / (len(own) + len(grams)) if own else 0
        assert (got[i]["dice"] or 0) == (dice if dice >= 0.5 else 0)


def test_odd_rows(spark, odd):
    df = odd.withColumnsRenamed({"lang": "stated", "source": "license"})
    got = scan_licences(df).collect()
    assert len(got) == 8 and all(r["license"] is None and r["n_units"] == 0 for r in got)
    assert scan_licences(df.limit(0)).count() == 0
    assert all(r["n_units"] == 0 for r in scan_licences(df, templates={}).collect())
