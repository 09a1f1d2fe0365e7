"""The nickname seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Nickname and canonical first name. Ambiguous ones (steve, kate, alex, sam, chris, ...) are left out on purpose.
NICKNAMES = {
    "bob": "robert", "bobby": "robert", "rob": "robert", "bill": "william", "billy": "william", "will": "william",
    "dick": "richard", "rich": "richard", "jim": "james", "jimmy": "james", "jamie": "james", "jack": "john",
    "johnny": "john", "mike": "michael", "mikey": "michael", "matt": "matthew", "matty": "matthew", "josh": "joshua",
    "dan": "daniel", "danny": "daniel", "dave": "david", "davey": "david", "tony": "anthony", "tom": "thomas",
    "tommy": "thomas", "joe": "joseph", "joey": "joseph", "ben": "benjamin", "benny": "benjamin", "nick": "nicholas",
    "nicky": "nicholas", "xander": "alexander", "jon": "jonathan", "jonny": "jonathan", "paddy": "patrick",
    "tim": "timothy", "timmy": "timothy", "greg": "gregory", "gregg": "gregory", "fred": "frederick",
    "freddie": "frederick", "larry": "lawrence", "liz": "elizabeth", "beth": "elizabeth", "eliza": "elizabeth",
    "lizzie": "elizabeth", "betty": "elizabeth", "maggie": "margaret", "meg": "margaret", "peggy": "margaret",
    "marge": "margaret", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "jen": "jennifer",
    "jenny": "jennifer", "jenni": "jennifer", "jess": "jessica", "jessie": "jessica", "stephie": "stephanie",
    "becky": "rebecca", "becca": "rebecca", "deb": "deborah", "debbie": "deborah", "barb": "barbara",
    "babs": "barbara", "sue": "susan", "susie": "susan", "vicky": "victoria", "tori": "victoria", "nicki": "nicole",
    "nikki": "nicole", "raj": "rajesh", "mani": "manpreet", "jas": "jaspreet", "sunny": "surinder",
    "indy": "inderjit", "abdul": "abdullah", "abdi": "abdullah", "paco": "francisco", "cisco": "francisco",
    "beto": "roberto", "lalo": "eduardo",
}


def nickname_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NICKNAMES.items()), "nickname string, canonical_first_name string")
