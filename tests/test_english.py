"""The stemmer against the sample vocabulary that its authors publish, and words for each rule."""

from pyspark.sql import functions as F

from regolith.functions import english

# Published words and their stems.
SAMPLE = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol
consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir
conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell
knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock
knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
""".split()
# One word or more for each rule, worked out by hand from the algorithm's description.
RULES = """
caresses caress flies fli ties tie dies die cries cri gas gas this this gaps gap kiwis kiwi skis ski skies sky dying die news news succeed succeed inning inning proceeded proceed
agreed agre feed feed hopping hop hoping hope fizzed fizz luxuriating luxuri bled bled tanned tan falling fall sized size snowing snow boxing box bowed bow
happy happi by by say say cry cri enjoy enjoy youth youth sayings say boyish boyish yes yes
relational relat conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
apologi apolog quickly quick hopelessli hopeless triplicate triplic formative format formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism communism
activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generously generous generate generat communities communiti arsenic arsenic
""".split()


def stems(spark, words):
    return spark.createDataFrame([(list(words),)], "w array<string>").select(english.stems(F.col("w"))).first()[0]


def test_published_sample(spark):
    words, want = SAMPLE[::2], SAMPLE[1::2]
    assert dict(zip(words, stems(spark, words))) == dict(zip(words, want))


def test_words_for_each_rule(spark):
    words, want = RULES[::2], RULES[1::2]
    got = dict(zip(words, stems(spark, words)))
    assert {w: got[w] for w in words} == dict(zip(words, want))


def test_possessives_and_short_words(spark):
    assert stems(spark, ["dog's", "dogs'", "'tis", "is", "as", "a", "", "y", "yy", "s"]) == ["dog", "dog", "tis", "is", "as", "a", "", "y", "yy", "s"]


def test_tokens(spark):
    rows = spark.createDataFrame([("The runners' heart-rates were RISING, and Café 12 rose.",), ("the and of",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(english.tokens(F.col("t"))).collect()] == [["runner", "heart", "rate", "rise", "café", "12", "rose"], [], [], []]
