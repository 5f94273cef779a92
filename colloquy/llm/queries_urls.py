"""The query on urls."""

from __future__ import annotations

from . import urlrules
from .common import table
from .registry import query


@query("op12_url_rules")
def op12(spark, folder):
    judged = urlrules.judge_urls(table(spark, folder, "pages"), table(spark, folder, "labels"))
    return judged.drop("confidence")
