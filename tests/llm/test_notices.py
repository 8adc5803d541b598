"""License notices of any length, and their later parts."""

from driftline.llm import licenses


def test_a_long_template_is_found_at_every_offset(spark):
    text = " ".join(f"t{k}" for k in range(150))
    docs = spark.createDataFrame([(at, " ".join([*["filler"] * at, text, *["end"] * 40])) for at in range(64)], "doc_id long, text string")
    assert {r.labels for r in licenses.scan(docs, (("long", text),)).collect()} == {"long"}


def test_later_parts_of_notices_are_labelled(spark):
    parts = [
        ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "mit-notice"),
        ("but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser License. This program is distributed in the hope that it will be useful, for more details general public", "gpl-notice"),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-notice"),
    ]
    docs = spark.createDataFrame([(k * 100 + at, "word " * at + text) for k, (text, _) in enumerate(parts) for at in range(0, 64, 7)], "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        assert parts[r.doc_id // 100][1] in r.labels.split(",")
    assert licenses.scan(spark.createDataFrame([(1, "the software is good and the use of any kind of it is free to all")], "doc_id long, text string")).first().labels == ""
