"""A small made-up paper with labelled questions, for trying the operators out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HEAD = "Orchard Health Review"
PAPER = [
    f"{HEAD}\n1\nResearch Article\nEvening Walking and Sleep in Retired\nGardeners of Two Harbour Towns\nLena Marsh, Tomás Øberg and Ruth Calloway\n1 University of Northbay, School of Health\nmarsh@northbay.example\nKeywords: walking, sleep\nAbstract\nThis study examines whether evening walking is associated with sleep among retired gardeners. We asked forty gardeners to keep diaries for six weeks.",
    f"{HEAD}\n2\n1. Introduction\nEarlier studies of sleep in later life have mostly looked at medication. Walking is cheap and safe, and many retired people already do it. The purpose of this study is to explore how evening walking relates to the quality of sleep.",
    f"{HEAD}\n3\nResearch Question\nDoes evening walking go with better sleep among retired gardeners?\nParticipants\nForty retired gardeners took part. Participants were recruited through two garden clubs by means of posters. They were aged between 61 and 84, and the mean age was 70.2 years.",
    f"{HEAD}\n4\nMethods\nData were collected with sleep diaries and semi-structured interviews in the homes of the participants. Interviews were recorded and coded by two readers. A thematic analysis followed, and tools such as Nvivo, Excel and Atlas were used to keep the codes.",
    f"{HEAD}\n5\nFindings\nParticipants who walked on most evenings reported fewer wakings at night than those who did not. Sleep diaries showed that walkers slept 41 minutes longer on average. Three themes were identified: light, company and routine.",
    f"{HEAD}\n6\nDiscussion\nThe pattern suggests that company matters as much as exercise. Clubs should offer evening walks. Our findings may partly reflect the mild summer in which the diaries were kept.",
    f"{HEAD}\n7\nLimitations\nThe small sample of gardeners means that the results cannot be generalised to other groups. Self-reported sleep was not checked with instruments. We found that walkers slept longer.",
    f"{HEAD}\n8\nConclusion\nEvening walking was associated with better sleep in this group of gardeners. Further research is needed.",
    f"{HEAD}\n9\nReferences\nHill, J. (2011). Sleep and age. Journal of Rest, 4(2): 11-19.\n[1] The clubs were chosen for convenience because they were close to the researcher and open to visits.",
]
QUESTIONS = [
    (1, "How many gardeners took part?", True, [3]),
    (2, "How were participants recruited?", True, [3]),
    (3, "How were the data collected?", True, [4]),
    (4, "What are the limitations of the study?", True, [6, 7]),
    (5, "What was the average IQ of the participants?", False, []),
    (6, "Which placebo was given in the control group trial?", False, []),
    (7, "What did the diaries show about walkers?", True, [5]),
    (8, "What is the aim of the study?", True, [1, 2, 3]),
]


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("gardeners", i, t) for i, t in enumerate(PAPER, 1)], "doc_id string, page_number int, text string")


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, "gardeners", q, a, p) for i, q, a, p in QUESTIONS], "question_id int, doc_id string, question string, expected_answerable boolean, expected_pages array<int>")
