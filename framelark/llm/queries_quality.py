"""Queries of the operators that count, score and judge single documents."""

from framelark.llm.common import read
from framelark.llm.isolation_rules import quality_rules
from framelark.llm.registry import query
from framelark.llm.site_quality import judge_documents
from framelark.llm.token_attribution import token_counts


@query("op2_token_attribution")
def token_attribution(spark, sf_dir):
    return token_counts(read(spark, sf_dir, "documents"))


@query("op5_site_quality")
def site_quality(spark, sf_dir):
    return judge_documents(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id"])


@query("op9_isolation_rules")
def isolation_rules(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
