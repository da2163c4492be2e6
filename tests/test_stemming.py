import pytest
from pyspark.sql import functions as F

from corpusloom.functions.stemming import stem

# Published sample pairs of the algorithm, and pairs the captured queries imply.
PAIRS = """
consign consign|consigned consign|consigning consign|consignment consign|consist consist|consisted consist
consistency consist|consistently consist|consolation consol|consolatory consolatori|consolidate consolid
consolidating consolid|consolingly consol|conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci
conspirator conspir|conspiring conspir|constable constabl|constancy constanc|knackeries knackeri|knavish knavish
kneeling kneel|knightly knight|knives knive|knitted knit|knockers knocker|knots knot
working work|tarnishing tarnish|soldering solder|layers layer|corrosion corros|surface surfac|original origin
metal metal|zinc zinc|paint paint|skies sky|dying die|news news|generous generous|generation generat
communication communic|arsenic arsenic|happy happi|by by|say say|enjoy enjoy|cry cri|ties tie|cries cri|gas gas
this this|gaps gap|kiwis kiwi|hoping hope|hopping hop|luxuriated luxuri|relational relat|rational ration
analogically analog|hopefulness hope|nationalization nation|adoption adopt|cement cement|controlling control
roll roll|possibly possibl|bed bed|shed shed|yes yes|youth youth|boyish boyish|sayings say|proceeds proceed
exceeding exceed|innings inning|agreed agre|feed feed|dog's dog|dogs' dog|'tis tis|apologies apolog|geology geolog
formative format|talkative talkat|singing sing|bring bring|using use|easily easili|electricity electr
goodness good|probate probat|fizzed fizz|falling fall|at at|I I
"""


@pytest.fixture(scope="module")
def pairs():
    return [p.split() for line in PAIRS.strip().splitlines() for p in line.split("|")]


def test_published_pairs(spark, pairs):
    df = spark.createDataFrame(pairs, "word string, want string").withColumn("got", stem("word"))
    assert df.where("got <> want").collect() == []


def test_null_and_filters_on_the_stem(spark, pairs):
    df = spark.createDataFrame([*pairs, [None, None]], "word string, want string").withColumn("got", stem("word"))
    assert df.where(F.col("got").isNull()).count() == 1
    assert df.where("got = 'work'").select("word").collect()[0][0] == "working"
