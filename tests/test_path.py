"""One call from CSV files to the submission."""

from antecede.modelling.path import run_files

HEADER = "event_id,game_session,timestamp,event_data,installation_id,event_count,event_code,game_time,title,type,world"
ASSESSMENTS = ("Mushroom Sorter (Assessment)", "Bird Measurer (Assessment)")


def line(user, session, second, title, kind, code, count=1, data="{}", event="e"):
    title = "" if title is None else f'"{title}"'
    payload = '"' + data.replace('"', '""') + '"'
    return f"{event},{session},2019-09-06T10:{second // 60:02d}:{second % 60:02d}.000Z,{payload},{user},{count},{code},0,{title},{kind},NONE"


def history(user, right):
    """Two assessments with activity before each; the first has a row without title, the second shares its instant with one."""
    rows = [line(user, f"{user}-g", 1, "Costume Box", "Game", 2000), line(user, f"{user}-g", 2, "Costume Box", "Game", 4070, 2, '{"x":3,"y":4}')]
    for n, second in ((1, 10), (2, 40)):
        session = f"{user}-a{n}"
        rows += [
            line(user, session, second, ASSESSMENTS[0], "Assessment", 2000),
            line(user, session, second + 1, ASSESSMENTS[0], "Assessment", 4100, 2, f'{{"correct":{str(right).lower()}}}'),
            line(user, f"{user}-n{n}", second + 5, None, "Activity", 4030, 1),
            line(user, f"{user}-t{n}", 40, "12 Monkeys", "Activity", 2000, 1),
        ]
    return rows


def test_files_to_submission(spark, tmp_path):
    def write(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    users = [f"u{i}" for i in range(8)]
    train = write("train.csv", HEADER, *(r for i, u in enumerate(users) for r in history(u, i % 2 == 1)), line("nolabel", "x", 1, "Costume Box", "Game", 2000))
    labels = write("labels.csv", "game_session,installation_id,title,num_correct,num_incorrect,accuracy,accuracy_group",
                   *(f"{u}-a1,{u},{ASSESSMENTS[0]},1,0,1.0,3" for u in users))
    test = write("test.csv", HEADER, *(r for u in ("t1", "t2") for r in history(u, True)))
    template = write("template.csv", "installation_id,accuracy_group", "t1,0", "t2,0", "absent,0")
    out = str(tmp_path / "out")
    got = run_files(spark, train, labels, test, template, out, k=2, params={"numTrees": 3, "maxDepth": 3}, default=1)
    rows = {r["game_session"]: r for r in got.train.collect()}
    assert set(rows) == {f"{u}-a{n}" for u in users for n in (1, 2)}
    assert all(r["accuracy_group"] == (3 if int(s[1]) % 2 else 0) for s, r in rows.items())
    first, second = rows["u0-a1"], rows["u0-a2"]
    # The row at the second anchor's own instant does not count; the row without title has no world of the anchor's.
    assert first["x1_cnt__costume_box"] == second["x1_cnt__costume_box"] == 1 and second["x1_cnt__12_monkeys"] == 0
    assert (first["count"], second["count"]) == (0, 0) or (first["count"], second["count"]) == (0, 1)
    assert first["seconds"] == 8 and second["hour"] == 10 and second["dayofweek"] == 4
    assert got.held_out.count() == 16
    (quality,) = got.quality.collect()
    assert -1 <= quality["kappa"] <= 1 and quality["log_loss"] >= 0
    assert abs(sum(r["share"] for r in got.classes.collect()) - 1) < 1e-9
    answer = {r["installation_id"]: r["accuracy_group"] for r in got.submission.collect()}
    assert set(answer) == {"t1", "t2", "absent"} and answer["absent"] == 1 and answer["t1"] in (0, 3)
    assert spark.read.csv(out, header=True).count() == 3
