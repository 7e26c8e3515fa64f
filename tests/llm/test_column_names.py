"""Other columns pass through, whatever their names."""

from stratoscope.llm import sentence_pieces

NAMES = ["doc_id", "text", "a.b", "a`.`b", "`", "c0", "c1", "__text", "__ids", "a b"]


def test_dots_and_backticks_in_names(spark):
    df = spark.createDataFrame([(1, "one two", *"defghijk"), (2, None, *"DEFGHIJK")], ["doc_id", "text", *[f"x{i}" for i in range(8)]]).toDF(*NAMES)
    coded = sentence_pieces.encode_pieces(df)
    assert coded.columns == [*NAMES, "ids"]
    made = sorted(map(tuple, sentence_pieces.decode_pieces(coded).drop("ids").collect()))
    assert made == [(1, "one two", *"defghijk", "one two"), (2, None, *"DEFGHIJK", "")]
