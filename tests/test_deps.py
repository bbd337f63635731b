"""The substring join of imported modules and file stems against plain ``in``."""

import random

from pyspark.sql import functions as F

from sourcelens.operators import deps as D
from sourcelens.operators import extract as E


def _python(modules):
    return "".join(f"import {m}\n" for m in modules)


def test_edges_equal_brute_force(spark, files_of):
    r = random.Random(3)
    letters = "abcé_"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    rows = []
    for k in range(60):
        stem = word(r.choice([1, 2, 3, 4, 5, 9])) if k % 9 else ""
        rows.append((f"d{k % 4}/{stem}.py", "python", _python(word(r.choice([1, 2, 3, 6, 12, 30])) for _ in range(r.randint(0, 6)))))
    files = files_of([x for k, x in enumerate(rows) if k % 2], "odd").unionByName(files_of([x for k, x in enumerate(rows) if not k % 2], "even"))
    analyzed = E.analyze(files)
    stems = {}
    for x in analyzed.select("repo", "path").collect():
        stems.setdefault(x.repo, set()).add(x.path.rsplit("/", 1)[-1].split(".")[0])
    imports = E.imports(analyzed).select("repo", "path", "ord", "module").collect()
    want = sorted(tuple(x) for x in imports if any(s in x.module for s in stems[x.repo]))
    assert sorted(tuple(x) for x in D.internal_dep_edges(analyzed).select("repo", "path", "ord", "module").collect()) == want
    no_empty = E.analyze(files.where("path NOT LIKE '%/.py'"))
    want = sorted(tuple(x) for x in imports if not x.path.endswith("/.py") and any(s and s in x.module for s in stems[x.repo]))
    got = sorted(tuple(x) for x in D.internal_dep_edges(no_empty).select("repo", "path", "ord", "module").collect())
    assert got == want and 0 < len(got) < len(imports)


def test_a_long_module_costs_in_proportion(spark):
    long = "".join(random.Random(1).choice("abcdefghij") for _ in range(10_000))
    mods = spark.createDataFrame([("r", long)], "repo string, module string")
    assert D._module_grams(mods).count() <= 3 * len(long)
    stems = spark.createDataFrame([("r", long[4000:4012]), ("r", "zzz"), ("r", "abcxyz")], "repo string, stem string")
    keyed = {x.stem: x.gram for x in D._stem_grams(stems, D._module_grams(mods)).collect()}
    assert set(keyed) == {long[4000:4012]} and keyed[long[4000:4012]] in long


def test_a_stem_is_looked_up_by_its_rarest_string(spark):
    mods = spark.createDataFrame([("r", f"common{k}") for k in range(50)] + [("r", "commonrare")], "repo string, module string")
    grams = D._module_grams(mods)
    keyed = D._stem_grams(spark.createDataFrame([("r", "commonr"), ("other", "common")], "repo string, stem string"), grams).collect()
    assert [(x.stem, x.gram) for x in keyed] == [("commonr", "onr")]
    assert grams.where(F.col("gram") == "onr").count() == 1
