"""What is known of a file, where sources disagree, and how two sides compare, by hand."""

from pyspark.sql import functions as F

from lakeloom.operators import metadata

TAGS = "array<struct<namespace:string,value:string,position:int>>"


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("out")).first().out


def file_columns():
    return {"file_actor": F.col("actor"), "file_type": F.col("type"), "file_origin": F.col("origin")}


def test_evidence_prefers_tags_and_falls_back_to_the_file(spark):
    schema = f"tags {TAGS}, category string, lineage array<string>, id string, actor string, type string, origin string"
    get = metadata.evidence(F.col("tags"), F.col("category"), F.col("lineage"), file_id=F.col("id"), **file_columns())
    tags = [("artist", "B", 4), ("Artist", " A ", 1), ("artist", "a", 2), ("group", "G", 3)]
    out = one(spark, schema, (tags, "unknown", ["7"], "5", "file actor", "Manga", "N/A"), get)
    assert (out.item_id, out.actors, out.groups, out.origins, out.category, out.lineage_ids) == ("5", ["A", "B"], ["G"], [], "Manga", ["7"])
    out = one(spark, schema, (None, None, None, None, "file actor", None, "place"), get)
    assert (out.actors, out.groups, out.origins, out.category, out.lineage_ids) == (["file actor"], [], ["place"], None, [])


def test_conflicts_need_both_sides(spark):
    schema = f"tags {TAGS}, category string, actor string, type string, origin string"
    get = metadata.conflicts(F.col("tags"), F.col("category"), **file_columns())
    tags = [("artist", "A", 0), ("parody", "Fate GO", 1)]
    assert one(spark, schema, (tags, "ArtistCG", "a", "artist cg", "fate grand order"), get) == []
    found = one(spark, schema, (tags, "Manga", "other", "artist cg", "elsewhere"), get)
    assert [(i.field, i.source_values, i.file_values) for i in found] == [("artist", ["A"], ["other"]), ("category", ["Manga"], ["artist cg"]), ("parody", ["Fate GO"], ["elsewhere"])]
    assert one(spark, schema, (tags, None, None, "artist cg", "unknown"), get) == []


def test_compatibility(spark):
    side = "struct<groups:array<string>,origins:array<string>,categories:array<string>>"
    get = metadata.compatibility(F.col("l"), F.col("r"))
    out = one(spark, f"l {side}, r {side}", ((["G"], ["x"], ["Image Set"]), (["g"], ["y"], ["imageset"])), get)
    assert (out.boost, out.reasons, out.mismatch) == (4, ["group", "category"], True)
    out = one(spark, f"l {side}, r {side}", (([], ["x"], []), (["g"], ["X"], ["manga"])), get)
    assert (out.boost, out.reasons, out.mismatch) == (2, ["origin"], False)
    out = one(spark, f"l {side}, r {side}", (([], [], []), ([], [], [])), get)
    assert (out.boost, out.reasons, out.mismatch) == (0, [], False)


def test_relation_and_display(spark):
    schema = "id string, own array<string>, ids array<string>, other array<string>"
    get = metadata.relation(F.col("id"), F.col("own"), F.col("ids"), F.col("other"))
    assert one(spark, schema, ("1", ["0"], ["1", "2"], []), get) == "exact"
    assert one(spark, schema, ("1", ["0"], ["2"], ["0"]), get) == "lineage"
    assert one(spark, schema, (None, [], ["2"], None), get) == "none"
    get = metadata.display(F.col("s"), F.col("f"))
    assert [tuple(one(spark, "s string, f string", r, get)) for r in (("a", "b"), (" ", "b"), (None, ""))] == [("a", "source"), ("b", "filename-fallback"), (None, "unknown")]
    assert one(spark, "a string, b string, c string", ("1", None, "1"), metadata.lineage(F.col("a"), F.col("b"), F.col("c"))) == ["1"]
