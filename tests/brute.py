"""Plain-Python scorer used only to check the Spark results."""

from __future__ import annotations

import re
import string

# They decide the scores and must be these exact words.
CORE = {
    "摄像机", "摄像头", "录像机", "NVR", "硬盘录像机", "网络硬盘录像机", "监控", "设备",
    "系统", "装置",
}
GROUPS = [
    {"NVR", "网络硬盘录像机", "硬盘录像机", "录像机"},
    {"摄像机", "摄像头", "监控摄像头", "监控摄像机"},
]
STOP = {"kg", "mm", "cm", "dm", "km", "包括", "包含"}
TYPES = ["热成像", "抓拍", "普通"]
LOW = "".join(chr(i) for i in range(33))
SPLIT = re.compile(r"[\s" + re.escape(string.punctuation) + r"\d]+", re.ASCII)


def is_han(ch):
    return "一" <= ch <= "龥"


def core(k):
    return k in CORE or k.upper() == "NVR"


def keywords(text):
    """Set of keywords of a text."""
    if text is None or not text.strip(LOW):
        return set()
    body = re.sub(r"[ \t\n\v\f\r   -     　]+",
                  " ", text.strip(LOW))
    body = re.sub(r"[（）()【】\[\]《》<>]", "", body)
    body = re.sub(r"[0-9]+[路块个套台TGMK]+", "", body)
    body = re.sub(r"[0-9]+", "", body)
    found = set()
    for part in SPLIT.split(body):
        if 2 <= len(part) <= 20:
            found.add("".join(c for c in part if is_han(c) or c in string.ascii_letters))
    for n in (2, 3, 4):
        windows = (body[i:i + n] for i in range(len(body) - n + 1))
        found.update(w for w in windows if all(map(is_han, w)))
    found.update(c for c in CORE if c in text)
    if "NVR" in text.upper():
        found.add("NVR")
    return {k for k in found if len(k) >= 2} - STOP


def synonyms(a, b):
    return a.lower() == b.lower() or any(a in g and b in g for g in GROUPS)


def points(k, k2):
    if k == k2:
        return 20 if core(k) else 10
    if synonyms(k, k2):
        return 15 if core(k) else 8
    return 5 if k in k2 or k2 in k else 0


def similarity(a, b):
    if not a or not b:
        return 0.0
    s = sum(max(points(k, k2) for k2 in b) for k in a) / 10.0 / (len(a) + len(b))
    return min(1.0, s * 1.3) if any(core(k) for k in a & b) else s


def strip(text):
    return re.sub(r"[（(].*?[）)]", "", text).strip(LOW)


def text_score(a, b):
    if not (a or "").strip(LOW) or not (b or "").strip(LOW):
        return 0.0
    a, b = strip(a), strip(b)
    ka, kb = keywords(a), keywords(b)
    inside = a in b or b in a
    if not ka or not kb:
        return 0.3 if inside else 0.0
    if any(x in a and y in b for x in TYPES for y in TYPES if x != y):
        return 0.0
    if a == b:
        return 1.0
    s = similarity(ka, kb)
    return max(s, 0.7) if inside else s


def weighted(a, b, weights):
    """Share of the weight of ``a`` that ``b`` also holds."""
    whole = sum(weights.get(k, 1.0) for k in sorted(a))
    return sum(weights.get(k, 1.0) for k in sorted(a & b)) / whole if whole else 0.0


def pair_score(item, quota, weights=None):
    """Score of (name, feature) pairs."""
    (n, f), (qn, qf) = [[(t or "").strip(LOW) for t in side] for side in (item, quota)]
    pool, qpool = keywords(n) | keywords(f), keywords(qn) | keywords(qf)
    total = weight = 0.0
    if n and qn:
        total, weight = total + text_score(n, qn) * 0.4, weight + 0.4
    if f and qf:
        total, weight = total + text_score(f, qf) * 0.3, weight + 0.3
    if qpool:
        pooled = similarity(pool, qpool) if weights is None else weighted(pool, qpool, weights)
        total, weight = total + pooled * 0.3, weight + 0.3
    return total / weight if weight else 0.0


def best(item, quotas, early=0.8, weights=None):
    """First good-enough or else best quota of [(id, name, feature)]."""
    if not keywords((item[0] or "").strip(LOW)) | keywords((item[1] or "").strip(LOW)):
        return None
    top = None
    for qid, qn, qf in sorted(quotas):
        s = pair_score(item, (qn, qf), weights)
        if s > 0 and (top is None or s > top[1]):
            top = (qid, s)
            if early is not None and s >= early:
                break
    return top if top and top[1] >= 0.3 else None
