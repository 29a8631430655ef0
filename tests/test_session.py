"""Scratch blocks: what is written inside goes, what is kept stays, and threads do not see each other's."""

from concurrent.futures import ThreadPoolExecutor

from callmark.session import kept, materialise, scratch, work_dir


def test_scratch(spark):
    with scratch(spark):
        inner, outer = materialise(spark.range(3)), kept(spark.range(4))
        folder = inner.inputFiles()[0]
        with scratch(spark):
            deep = work_dir(spark)
        assert work_dir(spark).rsplit("/", 1)[0] in folder and deep.rsplit("/", 1)[0] not in work_dir(spark)
    assert outer.count() == 4
    assert not spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(folder))


def test_threads(spark):
    def one(n):
        with scratch(spark):
            held = [materialise(spark.range(n)) for _ in range(3)]
            return [x.count() for x in held], work_dir(spark)

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(one, range(1, 9)))
    assert [x for x, _ in found] == [[n] * 3 for n in range(1, 9)] and len({d.rsplit("/", 1)[0] for _, d in found}) == 8
