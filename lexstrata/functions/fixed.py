"""Word lists, patterns and tables that results depend on. Nothing here is logic."""

# fixed values: dates
FIRST_DAY, LAST_DAY = "2000-01-01", "2025-12-31"

# fixed values: case numbers and courts
CASE_NUMBER = r"(?<!\d)((?:19|20)\d{2})\s*([가-힣]{1,5})\s*(\d{1,8})(?!\d)"
LABELLED_CASE_NUMBER = r"(?:사건|사건번호)\s*[:：]?\s*((?:19|20)\d{2}\s*[가-힣]{1,5}\s*\d{1,8})"
SUPREME_CODES = ("다",)
LOWER_CODES = ("가합", "가단", "가소", "나", "라")
SUPREME_HEADER = r"(?:^|\n)\s*대법원\s*(?:판결|결정)"
SUPREME_DISPOSITION = r"(?:상고|재상고)를 (?:기각|각하)한다|원심판결을 (?:파기|일부 파기)"
SUPREME_REASONING = r"상고이유(?:를|에 대하여)|원심판결 이유에 의하면"
LOWER_COURTS = ("고등법원", "지방법원", "가정법원")
DECISION_HEADER = r"(?:판결)?선고\s*[:：]?\s*((?:19|20)\d{2}[.\-/년\s]+\d{1,2}[.\-/월\s]+\d{1,2}(?:일)?)"

# fixed values: domains in order of preference, with the weight of a hit
DOMAINS = (
    ("medical_professional_liability", 2, r"(?i)손해배상\(의\)|의료(?:과오|사고)|의사|병원|수술|진료|투약|간호|medical malpractice|professional negligence|physician|hospital|surgery"),
    ("product_liability", 2, r"(?i)손해배상\(제\)|제조물책임|제품.{0,20}(?:결함|위험)|결함.{0,20}제품|product(?:s)? liability|strict products liability|defective product|failure to warn"),
    ("general_negligence_personal_injury", 1, r"(?i)손해배상\((?:자|산)\)|과실|주의의무|안전배려의무|교통사고|추락|상해|사망|자동차|추돌|충돌|보행자|negligen(?:ce|t|tly)|personal injury|wrongful death|premises liability|duty of care"),
    ("other_civil_liability", 1, r"(?i)손해배상|불법행위|위자료|명예훼손|프라이버시|일조권|부당이득|방해|구상금|civil liability|civil damages|tort|defamation|privacy|nuisance|intentional infliction|conversion"),
)
TAGS = (
    ("vicarious_liability", r"(?i)사용자책임|피용자.{0,40}업무집행|vicarious liability|scope of employment"),
    ("respondeat_superior", r"(?i)respondeat superior"),
    ("negligent_supervision", r"(?i)감독.{0,20}(?:과실|책임)|negligent (?:hiring|retention|supervision)"),
    ("premises_liability", r"(?i)공작물.{0,30}책임|영조물|점유자.{0,30}책임|premises liability"),
    ("wrongful_death", r"(?i)사망.{0,30}손해배상|유족|wrongful death"),
    ("comparative_fault", r"(?i)과실상계|과실비율|비교과실|comparative (?:fault|negligence)|contributory negligence"),
    ("intentional_misconduct", r"(?i)고의.{0,20}(?:불법행위|가해)|intentional (?:tort|misconduct)|willful misconduct"),
    ("punitive_or_multiple_damages_salient", r"(?i)징벌적 손해배상|배액배상|punitive damages|treble damages|multiple damages"),
)
CORE_LIABILITY = (
    r"(?i)손해배상|불법행위|제조물책임|사용자책임|의료(?:과오|사고)|과실|주의의무|상해|사망|"
    r"negligence|personal injury|wrongful death|medical malpractice|professional negligence|product(?:s)? liability|"
    r"defective product|failure to warn|premises liability|vicarious liability|respondeat superior|negligent supervision|compensatory damages"
)
EXCLUSIONS = (
    ("criminal_case", r"(?i)피고인|형법|징역|벌금|공소사실|habeas|criminal defendant|conviction|sentence of imprisonment"),
    ("administrative_only", r"(?i)행정처분|처분취소|영업정지|허가취소|administrative agency|judicial review of agency"),
    ("insurance_only", r"(?i)보험금 청구|보험계약.{0,80}(?:면책|보상)|insurance coverage|duty to defend|policy exclusion"),
    ("contract_only", r"(?i)대금청구|매매대금|공사대금|대여금|breach of contract|contract payment"),
)
FATAL = ("criminal_case", "administrative_only")

# fixed values: facts
FACTS = (
    ("fact_has_parties", r"(?i)\[(?:PERSON|COMPANY|ORGANIZATION|INSTITUTION)_[A-Z]+\]|원고|피고|피해자|가해자|환자|의사|회사|employee|employer|plaintiff|defendant|patient|manufacturer"),
    ("fact_has_conduct", r"(?i)하였다|하지 아니|운전|수술|제조|경고|설치|관리|failed to|drove|performed|manufactured|warned|supervised"),
    ("fact_has_context", r"(?i)\[(?:LOCATION|PROPERTY|INSTITUTION)_[A-Z]+\]|병원|도로|건물|사업장|현장|장소|hospital|road|premises|workplace|facility|at the"),
    ("fact_has_timeline", r"(?i)그 후|이후|당시|먼저|다음|\b(?:19|20)\d{2}\b|before|after|then|subsequently|when"),
    ("fact_has_harm", r"(?i)상해|사망|손상|장해|치료|손해|injur|death|died|damage|harm|loss"),
    ("fact_has_causation", r"(?i)인하여|때문에|결과|발생|초래|caused|resulted|because|leading to"),
    ("fact_has_defense_context", r"(?i)주장|다투|경고|동의|거부|알고|위험|alleg|disput|warn|consent|assum|comparative|defen"),
)
MANDATORY_FACTS = ("fact_has_parties", "fact_has_conduct", "fact_has_harm", "fact_has_causation")

# fixed values: opinions
OPINION_TYPES = (
    ("010combined", "combined"), ("015unamimous", "unanimous"), ("015unanimous", "unanimous"), ("020lead", "lead"), ("025plurality", "plurality"),
    ("030concurrence", "concurrence"), ("040dissent", "dissent"), ("080onthemerits", "on_the_merits"),
)
OPINION_PARTS = (("dissent", "dissent"), ("concurr", "concurrence"), ("plural", "plurality"), ("combined", "combined"), ("major", "combined"), ("unanim", "unanimous"), ("lead", "lead"), ("merit", "on_the_merits"))
OPINION_RANK = {"combined": 0, "unanimous": 1, "lead": 2, "on_the_merits": 3, "plurality": 8, "unknown": 9}
FEDERAL = r"(?i)United States|U\.S\.|Federal|Circuit|District Court"
STATES = (
    ("Alabama", "AL"), ("Alaska", "AK"), ("Arizona", "AZ"), ("Arkansas", "AR"), ("California", "CA"), ("Colorado", "CO"), ("Connecticut", "CT"), ("Delaware", "DE"), ("Florida", "FL"), ("Georgia", "GA"),
    ("Hawaii", "HI"), ("Idaho", "ID"), ("Illinois", "IL"), ("Indiana", "IN"), ("Iowa", "IA"), ("Kansas", "KS"), ("Kentucky", "KY"), ("Louisiana", "LA"), ("Maine", "ME"), ("Maryland", "MD"),
    ("Massachusetts", "MA"), ("Michigan", "MI"), ("Minnesota", "MN"), ("Mississippi", "MS"), ("Missouri", "MO"), ("Montana", "MT"), ("Nebraska", "NE"), ("Nevada", "NV"), ("New Hampshire", "NH"), ("New Jersey", "NJ"),
    ("New Mexico", "NM"), ("New York", "NY"), ("North Carolina", "NC"), ("North Dakota", "ND"), ("Ohio", "OH"), ("Oklahoma", "OK"), ("Oregon", "OR"), ("Pennsylvania", "PA"), ("Rhode Island", "RI"), ("South Carolina", "SC"),
    ("South Dakota", "SD"), ("Tennessee", "TN"), ("Texas", "TX"), ("Utah", "UT"), ("Vermont", "VT"), ("Virginia", "VA"), ("Washington", "WA"), ("West Virginia", "WV"), ("Wisconsin", "WI"), ("Wyoming", "WY"),
)

# fixed values: placeholders, numbers, units, negation
PLACEHOLDER = r"\[(?:PERSON|GROUP|COMPANY|ORGANIZATION|PRODUCT|VEHICLE|LOCATION|PROPERTY|INSTITUTION|CURRENCY_AMOUNT)_[A-Z]+\]"
NUMBER = r"(?<![A-Za-z0-9.])[-+]?\d+(?:[.,]\d+)?"
NUMBER_WORDS = (
    ("zero", "0"), ("one", "1"), ("first", "1"), ("two", "2"), ("second", "2"), ("three", "3"), ("third", "3"), ("four", "4"), ("fourth", "4"), ("five", "5"), ("fifth", "5"), ("six", "6"), ("sixth", "6"),
    ("seven", "7"), ("seventh", "7"), ("eight", "8"), ("eighth", "8"), ("nine", "9"), ("ninth", "9"), ("ten", "10"), ("tenth", "10"), ("eleven", "11"), ("eleventh", "11"), ("twelve", "12"), ("twelfth", "12"),
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
KOREAN_ONE = r"한쪽|한\s+(?:방향|대|명|개|곳|차례|번)(?:에는?|으로|에서|은|을|를|이|가|의|와|과|로|만|도)?(?=\s|$|[.,])"
KOREAN_COUNTERS = (
    ("1", r"(?<![가-힣])한\s+(?:명|개|대|곳|차례|번)(?:에는?|으로|에서|은|을|를|이|가|의|와|과|로|만|도)?(?=\s|$|[.,])"),
    ("2", r"(?<![가-힣])두\s+(?:명|개|대|곳|차례|번)(?:에는?|으로|에서|은|을|를|이|가|의|와|과|로|만|도)?(?=\s|$|[.,])"),
    ("3", r"(?<![가-힣])세\s+(?:명|개|대|곳|차례|번)(?:에는?|으로|에서|은|을|를|이|가|의|와|과|로|만|도)?(?=\s|$|[.,])"),
    ("4", r"(?<![가-힣])네\s+(?:명|개|대|곳|차례|번)(?:에는?|으로|에서|은|을|를|이|가|의|와|과|로|만|도)?(?=\s|$|[.,])"),
)
OTHERS = r"(?i)\band\s+(zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+others\b"
NEGATION = {
    "ko": r"않|아니|없|못",
    "en": r"(?i)\b(?:not|no|never|without|didn't|did not|couldn't|could not|stop(?:ped|ping)?|ceas(?:e|ed|ing)|fail(?:ed|ing)?|lack(?:ed|ing)?|omit(?:ted|ting)?|mis(?:read(?:ing)?|diagnos(?:e|ed|is)|interpret(?:ed|ation)?))\b",
}
UNITS = (
    ("km", r"(?i)킬로미터|kilomet(?:er|re)s?|\bkm\b"),
    ("m", r"(?i)(?<!킬로)미터|(?<!kilo)met(?:er|re)s?|(?<!k)\bm\b"),
    ("kg", r"(?i)킬로그램|kilograms?|\bkg\b"),
    ("celsius", r"(?i)섭씨|degrees? celsius|°\s*c\b"),
)

# fixed values: leakage
LEGAL_KO = r"(?i)민법\s*제?\d+조|대법원|원심판결|상고|판결|불법행위책임이 성립|책임을 인정|과실비율"
LEGAL_EN = (
    r"(?i)Cal\. Civ\. Code|Restatement|Supreme Court|Court of Appeals|held that|as a matter of law|summary judgment|"
    r"\baffirmed\b|\breversed\b|\b(?:default\s+|final\s+)?judgment\b|"
    r"\b\d+\s+(?:U\.S\.|S\.\s?Ct\.|F\.\s?(?:2d|3d|4th)|A\.\s?(?:2d|3d)|N\.E\.\s?(?:2d|3d)|N\.W\.\s?(?:2d|3d)|S\.E\.\s?(?:2d|3d)|S\.W\.\s?(?:2d|3d)|P\.\s?(?:2d|3d))\s+\d+\b"
)
COUNTRY_WORDS = r"대한민국|한국|미국"
COUNTRY_NAMES = r"Korea|Korean|United States|U\.S\."
GROUP_IDENTITY = r"(?i)\b(?:African[- ]American|American)s?\b|아프리카계\s*미국인"
STRICT = (
    ("procedural", r"(?i)원심(?:은|이).{0,80}판단하|대법원(?:은|이).{0,80}판단하|배심(?:원|은|이).{0,80}(?:판단|평결)|\b(?:the\s+)?(?:court|lower court|jury)\s+(?:held|found|concluded|determined)|\b(?:affirmed|reversed|remanded|summary judgment was appropriate)\b"),
    ("legal_conclusion", r"(?i)상당인과관계(?:가|는)?\s*인정|책임(?:이|을)\s*인정|주의의무(?:가|를)\s*(?:있|부담)|\bproximate cause was (?:established|proven)|\bforeseeable as a matter of law|\b(?:duty|breach|liability) (?:existed|was established|was proven)"),
    ("customary_unit", r"(?i)\b(?:miles?|feet|pounds?|mph)\b|\b\d+(?:\.\d+)?\s*(?:foot|ft)\b|\b(?:one|two|three|four|five|six|seven|eight|nine|ten)\s+foot\s+(?:high|long|wide|deep|away|from)\b|\bfoot-(?:high|long|wide|deep)\b"),
    ("currency", r"(?i)(?:\$|₩|\b(?:won|dollars?)\b|\d[\d,]*(?:\s*)원(?:\b|을|의|이|은|는|만|씩))"),
    ("kr_institution", r"주민등록증|서울특별시장|도지사|국토교통부장관"),
    ("jurisdiction_placeholder", r"\[(?:BOROUGH|COUNTY|STATE_AGENCY)_[A-Z]+\]"),
)

# fixed values: sources that are out of scope, and signals beside them
SOURCE_SIGNALS = (
    ("attorney_disciplinary", r"(?i)ATTORNEY DISCIPLINARY|disciplinary (?:matter|proceeding)|Office of Disciplinary Counsel"),
    ("workers_compensation", r"(?i)workers['’]? compensation|workmen['’]?s compensation|compensation appeal board"),
    ("insurance_coverage_only", r"(?is)declaratory (?:judgment|action).{0,100}(?:coverage|insurance)|insurance coverage|duty to (?:defend|indemnify)|pollution exclusion|coverage exclusion|insurance-contract indemnity"),
)
PATENT = r"(?i)\b(?:patent|royalt(?:y|ies)|technology licens(?:e|ing))\b"
DEFECT = r"(?i)\b(?:design defect|manufacturing defect|failure to warn|defective product|strict products? liability)\b"
TREATMENT = r"(?i)의료과실|의료사고|진료상 과실|malpractice|failure to diagnose|negligent professional service"
INCIDENTAL = r"(?i)\b(?:doctor|physician|medical records?|treatment|expert witness)\b|의사|진료기록|치료|감정인"

# fixed values: citations to strip
CITATIONS = (
    r"(?i)민법\s*제?\s*\d+\s*조(?:의\s*\d+)?",
    r"(?i)대법원\s*(?:19|20)\d{2}[.\s/-]+\d{1,2}[.\s/-]+\d{1,2}[.]?\s*선고\s*(?:19|20)\d{2}[가-힣]+\d+\s*판결",
    r"(?i)\b\d+\s+[A-Z][A-Za-z0-9. ]{0,18}\s+\d+(?:\s*\([^)]+\))?",
    r"(?i)\b(?:19|20)\d{2}\s+[A-Z][A-Za-z.]+\s+LEXIS\s+\d+\b",
)

# fixed values: corpus features
TOKEN = r"[가-힣]+|[A-Za-z]+(?:'[A-Za-z]+)?|\d+(?:,\d{3})*(?:\.\d+)?|§+|제\d+조"
DOCTRINE = ("duty of care", "breach of duty", "negligence", "proximate cause", "causation", "foreseeability", "comparative negligence", "contributory negligence", "strict liability", "standard of care", "reasonable person", "but-for causation", "substantial factor")
REMEDY = ("compensatory damages", "punitive damages", "nominal damages", "injunction", "damages", "pain and suffering", "emotional distress", "lost wages", "medical expenses", "wrongful death")
PROCEDURE = ("summary judgment", "motion to dismiss", "appeal", "remand", "affirmed", "reversed", "de novo", "motion for judgment", "directed verdict", "judgment as a matter of law")
JURISDICTION = ("United States", "federal court", "district court", "circuit court", "Supreme Court", "Court of Appeals", "state court")
