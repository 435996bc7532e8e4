"""Patterns and word lists as Java regular expressions.

All prose patterns carry (?iuU): without u the case of Vietnamese letters does not fold, without U \\s and \\b are ASCII.
Words are written [\\p{L}\\p{N}_], because \\w under U also takes combining marks.
"""

from __future__ import annotations

FLAGS = "(?iuU)"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Line ends of a text: CR LF and every single character that ends a line in Unicode text.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
#: Those beside the line feed.
OTHER_LINE_END = "[\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Runs of white space but a single blank; printable ASCII is passed over first.
NOT_ONE_BLANK = r"(?U)[^!-~](?:(?<= )[\s\x1c-\x1f]+|(?<=[\s\x1c-\x1f&&[^ ]])[\s\x1c-\x1f]*)"

# ---- fixed values: the citation grammar -------------------------------------------------------------------------
_NUMBER = r"\p{Nd}{1,4}[a-zA-ZđĐ]?"
_ARTICLE = "điều"
_MORE_NUMBERS = rf"(?:\s*(?:,|và|hoặc|\s+(?={_ARTICLE}\b))\s*(?:{_ARTICLE}\s*)?{_NUMBER})*"
#: The list after an article may be possessive, since all that follows it is optional, and Java recurses for others;
#: the list of a clause must give back the article that ends it.
_NUMBERS = _NUMBER + _MORE_NUMBERS + "+"
_CLAUSES = _NUMBER + _MORE_NUMBERS
_POINTS = r"[a-zA-ZđĐ](?:\s*,\s*[a-zA-ZđĐ])*(?:\s*(?:và|hoặc)\s*[a-zA-ZđĐ])?"
_POINT_PART = rf"(?:điểm\s+{_POINTS}\s*)?"
_CLAUSE_PART = rf"(?:khoản\s+(?:{_CLAUSES})?(?:\s*,\s*khoản\s+{_CLAUSES})*\s*)?"
_LAW_SHORT = "(?:BLHS|BLDS|BLTTDS|BLTTHS|BLTTHC)"
_LAW_KIND = r"(?:Bộ\s+luật|Luật|Nghị\s+quyết|Nghị\s+định|Thông\s+tư|Pháp\s+lệnh|Án\s+lệ)"
_LEAD = (
    r"(?:(?:căn\s+cứ|áp\s+dụng|theo\s+quy\s+định\s+tại|quy\s+định\s+tại|phù\s+hợp\s+(?:với\s+)?quy\s+định\s+tại|"
    r"vi\s+phạm\s+quy\s+định\s+tại|được\s+quy\s+định\s+tại|tại|các?)\s*[:,-]?\s*)?"
)
_TAIL = r"[^.;\n]{0,180}"


def law_name(amendment: bool = False) -> str:
    """A short name with a year, or a kind of law and what follows it. amendment also takes a bracketed amendment note."""
    note = r"(?:\s*\(\s*(?:sửa\s+đổi,\s*bổ\s+sung|sửa\s+đổi|bổ\s+sung)[^)]*\))?" if amendment else ""
    return rf"(?:{_LAW_SHORT}\b(?:\s*(?:năm\s*)?\(?\p{{Nd}}{{4}}\)?)?{note}|{_LAW_KIND}\b{_TAIL}{note})"


ARTICLE_UNIT = rf"{FLAGS}(?:các\s+)?{_POINT_PART}{_CLAUSE_PART}{_ARTICLE}\s*{_NUMBERS}"
LAW_NAME = FLAGS + law_name()


def citation(amendment: bool = False) -> str:
    name = law_name(amendment)
    more = rf"(?:\s*(?:,|;|và|hoặc|\s+(?={_ARTICLE}\b))\s*(?:(?:{_POINT_PART}{_CLAUSE_PART}{_ARTICLE}\s*)?{_NUMBERS}))*+"
    by_article = rf"{_LEAD}(?:các\s+)?{_POINT_PART}{_CLAUSE_PART}{_ARTICLE}\s*{_NUMBERS}{more}(?:\s*(?:của|thuộc|theo)?\s*{name})?"
    by_law = rf"{_LAW_KIND}\s*(?:số|số:)?\s*[\p{{L}}\p{{N}}_./-]+{_TAIL}"
    return f"{FLAGS}(?:{by_article}|{by_law})"


CITATION = citation()
#: Fixed value: the plainer pattern of snippet inference; counts in any case, over any white space.
SNIPPET = FLAGS + r"(?:các\s+)?(?:Điều|khoản|điểm)\s+[\p{Nd},\s]+(?:và\s+[\p{Nd},\s]+)?[^.]*\."
#: Law words that a ';' before "của/thuộc/theo" may precede; case law only in the tagger's variant.
LAW_START = r"(?:bộ\s+luật|luật|BLHS|BLDS|BLTTDS|BLTTHS|BLTTHC|nghị\s+quyết|nghị\s+định|thông\s+tư|pháp\s+lệnh)"
LAW_START_TAGGER = r"(?:bộ\s+luật|luật|BLHS|BLDS|BLTTDS|BLTTHS|BLTTHC|nghị\s+quyết|nghị\s+định|thông\s+tư|pháp\s+lệnh|án\s+lệ)"
LAWYER = "luật sư"
TRIAGE_WORDS = ["BLHS", "BLTTHS", "BLDS", "BLTTDS", "nghị quyết", "bộ luật"]
SHORT_NAMES = {
    "blhs": "bộ luật hình sự",
    "blds": "bộ luật dân sự",
    "blttds": "bộ luật tố tụng dân sự",
    "bltths": "bộ luật tố tụng hình sự",
    "bltthc": "bộ luật tố tụng hành chính",
}

# ---- fixed values: section markers ------------------------------------------------------------------------------
MARKERS = ["preamble", "noi_dung_vu_an", "dai_dien_vks", "nhan_dinh", "quyet_dinh"]
_HEADING = r"^\s*#{0,6}\s*(?:[IVX]+|\p{Nd}+)?[.)-]?\s*"
_OPENING = r"^\s*#{0,6}\s*(?:\p{Nd}+[.)-]\s*)?"
#: Fixed values. marker: phrases after a heading's number, phrases anywhere. A blank stands for any white space; each marker
#: becomes one alternation.
_PHRASES = {
    "preamble": (["NHÂN DANH\\b", "NHAN DANH\\b"], ["NƯỚC CỘNG H[ÒO]A X[ÃA] HỘI CHỦ NGHĨA VIỆT NAM", "NUOC CONG HOA XA HOI CHU NGHIA VIET NAM"]),
    "noi_dung_vu_an": (["NỘI DUNG VỤ ÁN", "NOI DUNG VU AN", "NỘI DUNG BẢN ÁN", "NOI DUNG BAN AN", "THEO C[ÁA]C T[ÀA]I LIỆU", "QU[ÁA] TR[ÌI]NH (?:ĐIỀU TRA|GIẢI QUYẾT)"], []),
    "dai_dien_vks": (["ĐẠI DIỆN VIỆN KIỂM S[ÁA]T", "DAI DIEN VIEN KIEM SAT", "ĐẠI DIỆN VKS", "KIỂM S[ÁA]T VI[ÊE]N.*(?:ĐỀ NGHỊ|PH[ÁA]T BIỂU)"], ["VIỆN KIỂM S[ÁA]T.*(?:ĐỀ NGHỊ|PH[ÁA]T BIỂU|QUAN ĐIỂM)"]),
    "nhan_dinh": (["NHẬN ĐỊNH CỦA T[ÒO]A [ÁA]N", "NHAN DINH CUA TOA AN", "NHẬN ĐỊNH CỦA HỘI ĐỒNG X[ÉE]T XỬ", "HỘI ĐỒNG X[ÉE]T XỬ NHẬN ĐỊNH", "HĐXX NHẬN ĐỊNH"], []),
    "quyet_dinh": (["QUYẾT ĐỊNH", "QUYET DINH", "V[ÌI] C[ÁA]C L[ẼE] TR[ÊE]N", "TUY[ÊE]N XỬ"], []),
}
_HARD = [r"\bnhân danh\b", r"\bnội dung\b", r"\bviện kiểm s[áa]t\b", r"\bkiểm s[áa]t vi[êe]n\b", r"\bnhận định\b", r"\bquyết định\b", r"\btuyên xử\b", r"\bhđxx\b", r"\bhội đồng x[ée]t xử\b"]


def _any(parts: list[str]) -> str:
    return "(?:" + "|".join(parts).replace(" ", r"\s+") + ")"


def _marker(name: str) -> str:
    headed, free = _PHRASES[name]
    head = _OPENING if name == "preamble" else _HEADING
    return FLAGS + "|".join([head + _any(headed), *([_any(free)] if free else [])])


def ahead(openings: list[str]) -> str:
    """A lookahead, of two plain character classes, for every case that Java folds to one of the openings (of one length each)."""
    other = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
    cases = lambda k: "".join(sorted({c for x in openings for c in (x[k].lower() + x[k].upper() + other.get(x[k].lower(), ""))}))
    return "(?=" + "".join(f"[{cases(k)}]" for k in range(len(openings[0]))) + ")"


class Pack:
    """A set of patterns: citations, a marker pattern for each type, and look-alikes of markers."""

    def __init__(self, citation: str, markers: dict[str, str], hard: str, unwanted: str, openings: list[str]):
        """openings: the two characters that a citation may begin with; places that have others are passed over before the pattern is tried."""
        self.citation, self.markers, self.hard, self.unwanted = citation, markers, hard, unwanted
        self.quick_citation = f"{ahead(openings)}(?:{citation})"


_OPENINGS = ["că", "áp", "th", "qu", "ph", "vi", "đư", "tạ", "cá", "đi", "kh", "bộ", "lu", "ng", "án"]
LEGAL_VI = Pack(CITATION, {m: _marker(m) for m in MARKERS}, FLAGS + _any(_HARD), LAWYER, _OPENINGS)
#: Own pack for English licence and notice lines, in the plain syntax that SQL engines share.
LICENSE_EN = Pack(
    r"(?i)(?:this work is licensed|licensed|released) under [^.;\n]{0,80}|all rights reserved",
    {
        "preamble": r"(?i)^this work is licensed",
        "noi_dung_vu_an": r"(?i)^licensed under",
        "dai_dien_vks": r"(?i)^released under",
        "nhan_dinh": r"(?i)^all rights",
        "quyet_dinh": r"(?i)rights reserved",
    },
    r"(?i)(?:^the |!!| \| )",
    "not licensed",
    ["th", "li", "re", "al"],
)
#: ---- fixed values: a heading's number
HEADING_NUMBER = r"(?iuU)^\s*(?:[IVX]+|\p{Nd}+)[.)-]"
