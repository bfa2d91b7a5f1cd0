import pytest

from antecede.sources import read_events, read_labels, read_template, write_submission

HEADER = "event_id,game_session,timestamp,event_data,installation_id,event_count,event_code,title,type,world"
COLUMNS = HEADER.split(",")


def test_quoted_json_and_numeric_looking_ids_survive(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text(
        HEADER + "\n"
        '27253bdc,s1,2019-09-06T17:53:46.937Z,"{""event_code"":2000,""correct"":true}",0001e90f,1,2000,Rulers,Clip,NONE\n'
    )
    (got,) = read_events(spark, str(path), COLUMNS).collect()
    assert got["installation_id"] == "0001e90f"
    assert got["event_data"] == '{"event_code":2000,"correct":true}'
    assert got["world"] == "NONE" and got["event_code"] == 2000
    assert got["ts"].microsecond == 937000


def test_a_header_that_differs_from_the_schema_fails(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("installation_id,grade\nu,3\n")
    with pytest.raises(Exception):
        read_template(spark, str(path)).collect()
    with pytest.raises(ValueError):
        read_events(spark, str(path), ["installation_id", "grade"])


def test_labels(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("game_session,installation_id,title,num_correct,num_incorrect,accuracy,accuracy_group\ns,u,T,1,0,1.0,3\n")
    (got,) = read_labels(spark, str(path)).collect()
    assert (got["installation_id"], got["title"], got["accuracy_group"]) == ("u", "T", 3)


def test_submission_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    write_submission(spark.createDataFrame([("u1", 3), ("u2", 0)], "installation_id string, accuracy_group int"), path)
    assert {tuple(r) for r in read_template(spark, path).collect()} == {("u1", 3), ("u2", 0)}
