import math

from webloom.operators import languages

TEXTS = {"en": "the thing that they think is there with this", "de": "der die das und nicht mit sich auch schon", "fr": "les des une dans que est pour avec ils"}


def test_profiles_and_likelihood_by_hand(spark):
    rows = [(1, "aab aab", "x"), (2, "abc", "y"), (3, "aab", None)]
    grams = languages.trigrams(spark.createDataFrame(rows, "doc_id int, text string, lang string"), "text", "doc_id", "lang")
    assert {(r["gram"], r["n"]) for r in grams.where("doc_id = 1").collect()} == {(" aa", 2), ("aab", 2), ("ab ", 2), ("b a", 1)}
    known = {(r["gram"], r["found"]): r["w"] for r in languages.profiles(grams).collect()}
    assert len(known) == 2 * 7
    assert math.isclose(known["aab", "x"], math.log(2.5 / (7 + 0.5 * 7))) and math.isclose(known["abc", "x"], math.log(0.5 / 10.5)) and math.isclose(known["abc", "y"], math.log(1.5 / (3 + 3.5)))
    found = {r["doc_id"]: r["found"] for r in languages.likeliest(grams, languages.profiles(grams), "doc_id").collect()}
    assert found == {1: "x", 2: "y", 3: "x"}


def test_detection_of_odd_texts(spark):
    rows = [(i, TEXTS[k], k) for i in range(30) for k in TEXTS]
    rows = [(n, text, lang) for n, (_, text, lang) in enumerate(rows)]
    odd = [(1000, None, None), (1001, "", "fr"), (1002, "die das", "de"), (1003, "это русский текст без ярлыка", None), (1004, "12345 67890 !!", None), (1005, "Der Mond und die Sonne scheinen nicht mit", None)]
    df = spark.createDataFrame(rows + odd, "doc_id int, text string, lang string")
    got = {r["doc_id"]: r for r in languages.detected(df).collect()}
    assert all(got[n]["detected_lang"] == lang for n, _, lang in rows) and 0 < sum(got[n]["held_out"] for n, _, _ in rows) < 60
    assert [got[n]["detected_lang"] for n, _, _ in odd] == ["en", "en", "en", "ru", "en", "de"]
    none = spark.createDataFrame([], "doc_id int, text string, lang string")
    assert languages.detected(none).columns == ["doc_id", "text", "lang", "held_out", "detected_lang"] and languages.detected(none).isEmpty()


def test_elements_of_an_ended_application_are_forgotten(spark, tmp_path):
    from webloom.plans import catalog

    class Ended:
        def unpersist(self):
            raise RuntimeError("its application has ended")

    spark.createDataFrame([(1, "https://a.example/", "<p>x</p>")], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    catalog._KEPT["an application that has ended"] = Ended()
    for _ in range(2):
        assert catalog.parsed(spark, str(tmp_path))[1].count() == 1
        assert list(catalog._KEPT) == [spark.sparkContext.applicationId]
