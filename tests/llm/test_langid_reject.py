"""Rejection learned from the sample: other languages and coded bytes go, clean documents stay."""

import base64
import random

from pyspark.sql import functions as F

from clean_texts import LATER, LEARNED, OTHER

from textgauge.llm import langid

FOLDER = "/root/testdata/sf0.01"
FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swojej osoby.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Kullakin yksilöllä on oikeus elämään, vapauteen ja henkilökohtaiseen turvallisuuteen.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Yaşamak, hürriyet ve kişi emniyeti her ferdin hakkıdır.",
    "zu": "Bonke abantu bazalwa bekhululekile belingana ngesithunzi nangamalungelo. Bahlanganiswe wumcabango nangunembeza futhi kufanele baphathane ngomoya wobunye. Wonke umuntu unelungelo lokuphila, inkululeko nokuphepha.",
}


def test_foreign_and_coded_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs.filter(~held_out))
    rng = random.Random(4)
    odd = dict(FOREIGN)
    odd |= {"base64": base64.b64encode(rng.randbytes(600)).decode(), "hex": rng.randbytes(400).hex()}
    given = spark.createDataFrame(list(odd.items()), "doc_id string, text string")
    rows = {r.doc_id: r for r in langid.identify(given, model).collect()}
    assert all(rows[k].rejected for k in odd), [(k, r.score, r.rejected) for k, r in rows.items()]
    said = langid.identify(docs.filter(F.col("text").rlike("\\p{L}")), model)
    lost = said.filter("rejected").select("doc_id", "score", F.length("text")).collect()
    assert lost == []


def test_texts_from_elsewhere(spark):
    """Ordinary texts of the learned languages stay; of others only a few near relatives do."""
    model = langid.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    for texts in (LEARNED, LATER):
        rows = [(lang, t) for lang, own in texts.items() for t in own]
        got = langid.identify(spark.createDataFrame(rows, "lang string, text string"), model).collect()
        assert [(r.lang, r.text) for r in got if r.rejected] == []
        assert [r.text for r in got if r.lang != r.lang_pred] == []
    got = langid.identify(spark.createDataFrame(list(OTHER.items()), "lang string, text string"), model).collect()
    kept = {r.lang for r in got if not r.rejected}
    assert kept <= {"nl", "pt", "sv", "it"}, kept
