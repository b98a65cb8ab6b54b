"""Model jobs with kept answers."""

from pyspark.sql import functions as F

from vellum.operators import registry


def test_every_prompt_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def ask(prompts):
        with open(log, "a") as f:
            f.writelines(f"{p}\n" for p in prompts)
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [f'{{"n": {len(p)}}}' if p else "none" for p in prompts]

    rows = [(1, "one"), (2, "one"), (3, "three"), (4, "a bad one"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    run = lambda model, given: {r["id"]: (r["n"], r["error"]) for r in registry.run_model_once(given, ask, "n int", f"{tmp_path}/store", model, F.col("text"), slices=3, tries=1).collect()}
    wanted = {1: (3, None), 2: (3, None), 3: (5, None), 4: (None, "no"), 5: (None, "no JSON in the answer"), 6: (None, "no JSON in the answer")}
    assert run("m", df) == wanted
    said = open(log).read().split("\n")
    # Prompts that stood in one batch with a bad one are asked again by themselves.
    assert 1 <= said.count("three") <= 2 and 1 <= said.count("a bad one") <= 2 and 1 <= said.count("one") <= 2
    assert run("m", df.unionByName(spark.createDataFrame([(7, "three")], df.schema))) == wanted | {7: (5, None)}
    assert open(log).read().split("\n") == said
    assert run("other", df.filter("id = 3")) == {3: (5, None)} and open(log).read().count("three") == said.count("three") + 1


def test_extractors_know_nested_fields(spark, tmp_path):
    answer = '{"spells": [{"name": "Fog", "level": 1, "ritual": false, "components": {"verbal": true, "material_cost": "5 gp"}, "classes": ["a", "b"], "damage": {"dice": "1d4"}}, {"level": 2}]}'
    found, failed = registry.extracted(spark.createDataFrame([(1, "text")], "id int, text string"), lambda prompts: [answer] * len(prompts), f"{tmp_path}/store", "m", "spells")
    (r,) = found.collect()
    assert (r["place"], r["name"], r["components"]["verbal"], r["components"]["material_cost"], r["classes"], r["damage"]["dice"], r["range"]) == (0, "Fog", True, "5 gp", ["a", "b"], "1d4", None)
    assert failed.count() == 0
