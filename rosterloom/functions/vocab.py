"""Vocabularies and tables that give the rules their meaning. Fixed values, stated in natural order."""

from __future__ import annotations

# Letters that aren't accented forms of ASCII letters, and what they become; German umlauts become digraphs.
EXPANSIONS = {
    "ß": "SS", "ü": "UE", "Ü": "UE", "ö": "OE", "Ö": "OE", "ä": "AE", "Ä": "AE", "æ": "AE", "Æ": "AE", "œ": "OE", "Œ": "OE",
    "þ": "TH", "Þ": "TH", "ĳ": "IJ", "Ĳ": "IJ", "ŉ": "'N",
}
SINGLE_LETTERS = {
    "ø": "O", "Ø": "O", "ł": "L", "Ł": "L", "đ": "D", "Đ": "D", "ð": "D", "Ð": "D", "ħ": "H", "Ħ": "H", "ĸ": "Q", "ŀ": "L", "Ŀ": "L",
    "ŋ": "N", "Ŋ": "N", "ŧ": "T", "Ŧ": "T", "ı": "I", "ſ": "S", "×": "*", "÷": "/",
}
PUNCTUATION = {"‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "–": "-", "—": "-", " ": " "}

# Particles that never count as a surname token; and those that alone never make one surname part of another.
SURNAME_PARTICLES = "DE DEL DELA DELAS DELOS LA LAS LE LOS DA DAS DI DO DOS VAN VANDER VON DER DEN TER TEN ST STE MC MAC EL AL BIN IBN BEN ABU Y I".split()
NAME_SURNAME_PARTICLES = "VAN VON DER DEN DE DEL DELLA DELA DI DA DU DO DOS DAS LA LE LO LOS LAS AF AV BIN IBN AL TER TEN OP ZU ST".split()
MIN_SURNAME_TOKEN = 4

# Titles, degrees and generation marks that are not part of a name; two of them are also surnames when written like one.
NAME_NOISE = (
    "DNP DNSC DNS PHD EDD MD DO MSN MSC MS MA MPH BSN BS BA RN APRN ARNP CNM CM CNS CRNP CRNA NP FNP WHNP PNP ANP AGNP IBCLC LCCE FACNM FAAN FACOG FACS FRCS RNC LM CPM "
    "DR PROF MR MRS MISS JR SR II III IV DDS DMD DC DPM OD PA PAC PA-C LPN LVN PSYD PHARMD RPH LCSW DPT"
).split()
SURNAME_CREDENTIAL_COLLISIONS = {"DO": "Do", "MA": "Ma"}
TRAILING_CREDENTIAL = r"(\s+(MD|M\.D\.|DO|D\.O\.|JR|SR|III|II|IV|PH\.\s?D\.)\.?)+$"

# Words of organisation names that identify nobody.
ORG_NOISE = (
    "INC LLC LLP LTD CORP CORPORATION PC PA PLLC PLC CO COMPANY GROUP ASSOCIATES ASSOC PARTNERS DBA MEDICAL MEDICINE HEALTH HEALTHCARE CLINIC CLINICS CENTER CENTERS "
    "CENTRE INSTITUTE FOUNDATION SERVICES CARE PROFESSIONAL PRACTICE OFFICE OFFICES THE OF AND A AN"
).split()

# Spellings of generation suffixes, and the generation each stands for.
SUFFIX_SPELLINGS = {"JR": "JR", "JNR": "JR", "JUNIOR": "JR", "SR": "SR", "SNR": "SR", "SENIOR": "SR", "II": "II", "2ND": "II", "III": "III", "3RD": "III", "IV": "IV", "4TH": "IV"}
SUFFIX_GENERATION = {"SR": 1, "JR": 2, "II": 2, "III": 3, "IV": 4}

# Degrees that a credential field is read for, with the spellings that mean them once dots are gone.
CREDENTIALS = {d: d for d in "MD DO PHD DNP DNSC EDD MSN MSC MS MPH BSN BS RN APRN ARNP CNM CM CNS CRNP CRNA NP FNP WHNP PNP ANP AGNP DDS DMD DC DPM OD PA LPN LVN PSYD PHARMD RPH LCSW DPT".split()} | {"PAC": "PA", "PA-C": "PA"}

# Years from credentialing to graduation, first band that holds decides: name, least, most, verdict, log2 likelihood ratio.
GRADUATION_YEAR_BANDS = [
    ("same_year", 0, 0, "corroborates", 5.45),
    ("one_before", -1, -1, "corroborates", 3.35),
    ("one_after", 1, 1, "corroborates", 0.81),
    ("two_three_before", -3, -2, "uninformative", -0.25),
    ("two_three_after", 2, 3, "uninformative", -1.37),
    ("four_ten_before", -10, -4, "uninformative", -1.57),
    ("four_ten_after", 4, 10, "uninformative", -2.00),
    ("beyond_ten", None, None, "conflicts", -3.16),
]

# Status words of licensing boards by class.
LICENSE_STATUS_LEVELS = {
    "active": ["ACTIVE", "ACTIVE IN RENEWAL", "CURRENT", "CLEAR", "CLEAR ACTIVE", "LICENSED", "REGISTERED", "FULL", "ACTIVE MILITARY", "GOOD STANDING", "IN GOOD STANDING"],
    "restricted": ["PROBATION", "PROBATIONARY", "RESTRICTED", "SUSPENDED", "SUSPENSION", "STAYED SUSPENSION", "LIMITED", "CONDITIONAL"],
    "retired": ["RETIRED", "VOLUNTARILY RETIRED", "VOLUNTARY RETIRED", "RETIRED VOLUNTARY", "EMERITUS", "RETIRED EMERITUS", "EMERITUS RETIRED", "INACTIVE RETIRED", "RETIRED INACTIVE"],
    "deceased": ["DECEASED", "DEATH", "EXPIRED DECEASED", "DECEASED EXPIRED"],
    "disciplinary": ["REVOKED", "REVOCATION", "SURRENDERED", "SURRENDER", "VOLUNTARY SURRENDER", "VOLUNTARILY SURRENDERED", "RELINQUISHED", "LICENSE SURRENDER", "SURRENDERED IN LIEU OF DISCIPLINE", "ANNULLED"],
    "lapsed": ["EXPIRED", "LAPSED", "DELINQUENT", "INACTIVE", "CANCELLED", "CANCELED", "NOT RENEWED", "NONRENEWED", "NULL AND VOID", "NULL VOID", "WITHDRAWN", "DISCONTINUED"],
}

# Prefixes of taxonomy codes by specialty; alternatives are separated by pipes.
TAXONOMY_FAMILY_PATTERNS = {
    "Obstetrics & Gynecology": "207V",
    "Family Medicine": "207Q",
    "Internal Medicine": "207R",
    "Anesthesiology": "207L",
    "Psychiatry": "2084",
    "Clinical Genetics": "207SG|2084G|207S",
    "Clinical Genetics and Genomics": "207SG|2084G|207S",
    "Anatomic Pathology": "207Z",
    "Pathology - Anatomic/Pathology - Clinical": "207Z",
    "Public Health & General Preventive Medicine": "2083",
}

# Phrases that name a medical unit of a university, longest sense first.
MEDICAL_UNIT_PATTERNS = [
    "SCHOOL OF MEDICINE AND DENTISTRY", "COLLEGE OF PHYSICIANS AND SURGEONS", "SCHOOL OF OSTEOPATHIC MEDICINE", "COLLEGE OF OSTEOPATHIC MEDICINE",
    "COLLEGE OF MEDICINE AND SURGERY", "SCHOOL OF DENTAL MEDICINE", "SCHOOL OF DENTAL MED", "COLLEGE OF DENTISTRY", "SCHOOL OF MEDICINE", "COLLEGE OF MEDICINE",
    "MEDICAL DEPARTMENT", "MEDICAL BRANCH", "MEDICAL SCHOOL", "MEDICAL COLLEGE", "MEDICAL CENTER", "MEDICAL UNIVERSITY", "COLLEGE OF MED", "SCHOOL OF MED", "SCH OF MED",
    "MED CTR", "MED SCH",
]
INSTITUTION_WORD = r"(?i)\b(UNIVERSITY|UNIV|UN OF|COLLEGE|INSTITUTE)\b"

# Attributes that matching can take besides names.
MATCH_ATTRIBUTES = ["gender", "credential", "taxonomy", "license", "graduation_year", "state"]

# What a source may do with nickname expansion, and the standing policy.
SOURCE_CLASSES = {"formal_record": "forbidden", "informal_capable": "review_only", "unknown": "fail_closed"}
NICKNAME_POLICY = {
    "policy_id": "nickname-policy-2026-09-07",
    "effective_date": "2026-09-07",
    "verdict_layer": "retain_global",
    "candidate_expansion": "retain_review_only",
    "auto_accept_rule": "never_on_nickname_evidence_alone",
    "source_class_gate": "registry_driven_fail_closed",
    "acceptance_contribution_levels": ["none", "supporting", "nickname_only", "necessary", "conflicting"],
}

# Nicknames by formal name: a seed. The full dictionary is a parameter of every rule that reads it.
NICKNAME_SEED_VERSION = "seed-1"
NICKNAME_SEED = {
    "ABIGAIL": "GAIL", "ALBERT": "AL", "ALEXANDER": "AL ALEX SASHA", "ALEXANDRA": "ALEX LEXIE SANDRA", "ALICE": "LISA", "ALICIA": "LISA", "ALLISON": "ALI ALLIE", "ANDREA": "ANDREW",
    "ANN": "NANCY", "BARBARA": "BARB BARBIE", "BENJAMIN": "BENJI", "CAROLYN": "CAROL CARRIE", "CASEY": "KC", "CATHERINE": "CATHY KATE KATIE KITTY", "CHARLES": "CHAS",
    "CHRISTINA": "CHRIS TINA", "CHRISTOPHER": "CHRIS KIT TOPHER", "CYNTHIA": "CINDY", "DAN": "DANNY", "DANIEL": "DAN DANNY", "DANIELLE": "DANI", "DAVID": "DAVE",
    "DEBORAH": "DEB DEBBIE DEBBY", "DIANE": "DIANA", "ELEANOR": "ELLA", "ELISA": "LISA", "ELIZABETH": "BETH BETTY ELIZA LISA LIZ LIZA", "EMILY": "EMMY", "GABRIELLA": "GABRIELLE",
    "GREGORY": "GREGG", "HAROLD": "HARRY", "HENRY": "HARRY", "JAMES": "JAMIE JIM JIMMY", "JEFFREY": "JEFFERY", "JENNIFER": "JEN JENNIE JENNY", "JESSICA": "JESS JESSIE",
    "JOANNA": "JOANNE", "JOHN": "JACK", "JOSEPH": "JOE JOEY", "JULIA": "JULIE", "KAREN": "KARIN", "KATHERINE": "CASSIE CATHY KATE KATHY KATIE KATY KITTY TRINA", "KIMBERLY": "KIMMY",
    "KRISTEN": "CHRIS", "LARRY": "LAWRENCE", "LAURA": "LORI", "LINDA": "LYNDA", "MARGARET": "MAGGIE MARGE MARGOT MEG PEG PEGGY", "MEGAN": "MEG", "MELINDA": "LINDA", "MELISSA": "LISA",
    "MICHAEL": "MICK MICKEY MIKE", "MICHELLE": "MICH MICHELE", "NATALIE": "NATTY", "PATRICIA": "PAT PATTY TRICIA TRISH", "PETER": "PETEY", "PHILIP": "PHILLIP", "RACHEL": "RAE",
    "RICHARD": "DICK RICH RICK", "ROBERT": "BOB BOBBY ROB ROBBIE", "ROBIN": "ROBBY", "SAMANTHA": "SAM", "SANDRA": "SANDI", "SARAH": "SADIE SARA", "SHERIDAN": "DAN",
    "STEPHANIE": "ANNIE STEFANIE STEPH STEVIE", "STEPHEN": "STEVE STEVEN", "SUSAN": "SUE SUZY", "TERESA": "TESSA", "THERESA": "TRACI TRACY", "THOMAS": "THOM TOM TOMMY",
    "TRACEY": "TRACY", "WILLIAM": "BILL BILLY WILL",
}
