import pytest
from pyspark.sql import functions as F

from lumenfield.functions import names
from lumenfield.operators import boxes, jobs, listing
from lumenfield.sources import boxes as saved

NAME = "jw01895002001_02010_00001_nrca1"


@pytest.fixture(scope="module")
def box(spark):
    rows = [(i, f"jw0{1895 + i % 2}002001_02010_0000{i}_nrca1", ("F115W", "F200W")[i % 2], "NRCA1", ("CLEAR", "GRISMR", "GRISMC")[i % 3], "2b", f"/d/{i}_cal.fits") for i in range(9)]
    return spark.createDataFrame(rows, "ord long, basename string, filter string, detector string, pupil string, stage string, filepath string")


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c"))).first()[0]


def test_names(spark):
    assert one(spark, names.basename, NAME + "_cal.fits") == NAME and one(spark, names.basename, "other.fits") == "other.fits"
    assert one(spark, names.fileset, NAME + "_cal.fits") == "jw01895002001_02010_00001" and one(spark, names.proposal_id, NAME) == "01895"
    assert [one(spark, names.expects_wcs, f"a_{s}.fits") for s in ("cal", "uncal", "rate", "rateints")] == [True, False, False, False]
    assert one(spark, names.normal_proposal_id, " 001895 ") == "01895"
    for bad in ("0000", "12x", "123456", ""):
        with pytest.raises(Exception, match="not a proposal id"):
            one(spark, names.normal_proposal_id, bad)
    with pytest.raises(Exception, match="no fileset"):
        one(spark, names.fileset, "other")


def keys(df):
    return sorted(r["ord"] for r in df.collect())


def test_selection_and_lookup(spark, box):
    assert keys(boxes.select(box, {"filter": ["F115W"], "pupil": ["CLEAR"]})) == [0, 6]
    assert keys(boxes.select(box, {"filter": "F115W"}, F.col("ord") == 1)) == [0, 1, 2, 4, 6, 8]
    with pytest.raises(ValueError):
        boxes.select(box)
    with pytest.raises(ValueError):
        boxes.select(box, {"nothing": [1]})
    assert keys(boxes.at(box, 3)) == [3] and keys(boxes.at(box, -1)) == [8]
    assert keys(boxes.at(box, slice(2, 8, 3))) == [2, 5] and keys(boxes.at(box, slice(-3, None))) == [6, 7, 8] and keys(boxes.at(box, slice(None, None, -2))) == [0, 2, 4, 6, 8]
    assert keys(boxes.at(box, [True, False] * 4 + [True])) == [0, 2, 4, 6, 8]
    first = box.where("ord = 0").first()["basename"]
    assert keys(boxes.at(box, first + "_cal.fits")) == [0] and keys(boxes.at(box, [first])) == [0]
    with pytest.raises(TypeError):
        boxes.at(box, [1, "a"])
    assert boxes.holds(box, first) and not boxes.holds(box, first + "_cal.fits")
    assert keys(boxes.example(box, first)) == [0, 2, 4, 6, 8]
    assert [r["ord"] for r in boxes.numbered(box.drop("ord").withColumn("k", F.reverse("basename")), "basename").orderBy("basename").collect()] == list(range(9))


def test_sample_has_every_combination(box):
    for seed in range(5):
        got = boxes.sample(box, 4, ("pupil",), seed).collect()
        assert len(got) == 4 and {r["pupil"] for r in got} == {"CLEAR", "GRISMR", "GRISMC"}
    assert len(boxes.sample(box, 2).collect()) == 2 and len(boxes.sample(box, 99).collect()) == 9


def test_sample_keeps_nulls_and_repeats_as_they_are(spark):
    rows = [("a", "X", None)] * 3 + [("b", None, None), ("c", "Y", "f")]
    df = spark.createDataFrame(rows, "basename string, pupil string, filepath string")
    for seed in range(4):
        assert sorted(map(str, boxes.sample(df, 99, ("pupil",), seed).collect())) == sorted(map(str, df.collect()))
        assert {r["pupil"] for r in boxes.sample(df, 3, ("pupil",), seed).collect()} == {"X", None, "Y"}


def test_random_target_and_length(box):
    got = boxes.random_target(box, 3).collect()
    assert len(got) == 1 and got[0]["basename"] in {r["basename"] for r in box.collect()}


def test_merge(spark, box):
    right = box.where("ord >= 5").withColumn("filepath", F.lit("new")).unionByName(box.where("ord = 0").withColumn("basename", F.lit("extra")).withColumn("ord", F.lit(9).cast("long")))
    left = box.where("ord <= 6")
    got = {r["ord"]: r["filepath"] for r in boxes.merge(left, right).collect()}
    assert len(got) == 10 and got[5] == "new" and got[0] != "new"
    assert keys(boxes.merge(left, right, discard=True)) == list(range(7))
    assert sorted(map(tuple, boxes.merge(left, left).collect())) == sorted(map(tuple, left.collect()))
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    n = boxes.merge_nested(boxes.nested(left), boxes.nested(right.withColumn("stage", F.when(F.col("ord") == 5, F.lit("3a")).otherwise(F.col("stage")))))
    stages = {r["basename"]: r["stages"] for r in n.collect()}
    five = box.where("ord = 5").first()["basename"]
    assert set(stages[five]) == {"2b", "3a"} and len(stages) == 10


def test_stage_and_combinations(box):
    new = box.where("ord < 3").withColumn("stage", F.lit("3a")).withColumn("pupil", F.when(F.col("ord") == 1, F.lit("X")).otherwise(F.col("pupil")))
    good, bad = boxes.add_stage(box, new)
    assert keys(good) == [0, 2] and keys(bad) == [1]
    with pytest.raises(Exception, match="more combinations"):
        boxes.combo_index(box, ("pupil",), 2).collect()
    assert keys(boxes.hide(box, {"pupil": ["CLEAR"], "filter": ["F200W"]}, "2b")) == [2, 4, 8]
    tree = boxes.summary_tree(box).orderBy("pupil").collect()
    assert [r["pupil"] for r in tree] == ["CLEAR", "GRISMC", "GRISMR"] and tree[0]["filters"][0]["filter"] == "F115W"


def test_saved_boxes(spark, box, tmp_path):
    path = str(tmp_path / "box.json")
    with pytest.warns(UserWarning):
        assert saved.load(spark, path).count() == 0
    saved.save(box, path)
    back = saved.load_saved(spark, path)
    assert back.count() == 9
    with pytest.raises(ValueError):
        saved.save(box.where("ord < 3"), path)
    saved.save(box.where("ord < 3"), path, force=True)
    assert saved.load_saved(spark, path).count() == 3
    doc = tmp_path / "a_x.json"
    doc.write_text('{"infos": {"n": {"basename": "n", "filter": "F1", "detector": "D", "pupil": "P",\n "cover_dict": {"2b": {"filepath": "/f", "footprint": {"vertices": [[0, 0], [1, 0], [1, 1], [0, 1]], "area": 1.0}}}}}, "proposal_ids": ["01895"]}')
    got = saved.load(spark, folder=str(tmp_path), name="a", suffix="x").first()
    assert got["basename"] == "n" and got["stage"] == "2b" and got["footprint"]["area"] == 1.0


def test_saved_footprints_come_back_and_a_box_replaces_its_own_file(spark, box, tmp_path):
    path = str(tmp_path / "whole.json")
    fp = F.struct(F.array(F.array(F.lit(0.0), F.lit(1.0))).alias("vertices"), F.array(F.array(F.lit(0).cast("long"))).alias("vertex_marker"), F.array(F.lit(0.5)).alias("center"), F.col("ord").cast("double").alias("area"), F.lit(2.0).alias("radius"))
    full = box.withColumn("footprint", F.when(F.col("ord") != 4, fp)).drop("ord")
    full = full.unionByName(full.withColumn("stage", F.lit("3a")))
    order = ["basename", "stage"]
    want = full.orderBy(*order).collect()
    saved.save(full, path)
    got = saved.load(spark, path)
    assert got.select(*full.columns).orderBy(*order).collect() == want
    saved.save(saved.update_from_folder(got, got.where("stage = '3a'").withColumn("filepath", F.lit("new"))), path)
    again = saved.load(spark, path).select(*full.columns).orderBy(*order).collect()
    assert [r["filepath"] for r in again if r["stage"] == "3a"] == ["new"] * 9 and [r["footprint"] for r in again] == [r["footprint"] for r in want]


def test_listing_files(spark, tmp_path):
    p = spark.createDataFrame([("d1_cal.fits", "d1", "2b", "_cal", "public", "NIRCAM", 2_000_000), ("d1_x.fits", "d1", "2b", "_x", "public", "NIRCAM", None)], "filename string, dataset string, category string, file_suffix string, access string, instrument_name string, size long")
    saved.save_products(p, str(tmp_path / "p"))
    assert saved.load_products(spark, str(tmp_path / "p")).count() == 2
    assert [r["size_text"] for r in listing.preview(p).collect()] == ["2.00 MB", "N/A"]


def test_job_outcomes(spark):
    def work(row):
        if row["i"] == 2:
            raise ValueError("no")

    out = jobs.run(spark.range(4).withColumnRenamed("id", "i"), work, "i")
    assert {r["i"]: r["error"] for r in out.collect()} == {0: None, 1: None, 2: "ValueError: no", 3: None}
    assert {r["status"]: r["n"] for r in jobs.outcome(out).collect()} == {"ok": 3, "failed": 1}
