import pytest

from attesta.functions.quantities import asserted, covers, offered

CASES = [
    ("about twenty-five percent", "25%", True), ("twenty-five percent", "5%", False), ("four hundred million", "400,000,000", True), ("5 million users", "5 billion users", False), ("one hundred and fifty", "150", True),
    ("in July 2026", "on 2026-07-28", True), ("on 28 July 2026", "in 2026-07", False), ("2026年7月28日", "28 July 2026", True), ("two dozen", "24", True), ("half a percent", "0.5 percent", True),
    ("3萬5千", "35,000", True), ("十八萬五", "185000", True), ("三點五千瓦", "3,500瓦", True), ("五千瓦", "5瓦", False), ("百分之三十五點五", "35.5%", True), ("零點八億", "80000000", True), ("6800萬", "6800億", False),
    ("六成八", "68%", True), ("v1.2.3", "version 1.2.3", True), ("CVE-2024-1234", "cve-2024-1234", True), ("三個漏洞", "3 flaws", True), ("五百分點", "5百分點", True),
]
SILENT = ["萬一", "千萬不要", "一個", "第三名", "三分之二", "two-thirds of it", "dozens", "每百公里", "See C12 and S3", "https://x.example/2026"]


@pytest.mark.parametrize("claim, evidence, ok", CASES)
def test_cover(claim, evidence, ok):
    forms = offered(evidence)
    assert asserted(claim)
    assert all(covers(q.forms, forms) for q in asserted(claim)) is ok


@pytest.mark.parametrize("text", SILENT)
def test_silent(text):
    assert asserted(text) == []
