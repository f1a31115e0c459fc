"""Dictionaries and patterns of free-text extraction."""

# What each label looks for; matched in lower-case text.
LABEL_PATTERNS = {
    "specialties": r"(cardiology|oncology|nephrology|neurology|orthopedics?|pediatrics?|gynecology|obstetrics|radiology|urology|dermatology|dentistry)",
    "equipment": r"(ecg|echo|ct scan(?:ner)?|mri|x-ray|ultrasound|ventilator|incubator|dialysis machine|cath lab)",
    "awards": r"((?:w\.?h\.?o|nobel|unesco|national|state)\.? (?:award|prize)(?: (?:19|20)[0-9]{2})?)",
    "certifications": r"(iso ?[0-9]{4,5}(?::[0-9]{4})?|nabh|jci|nabl)",
    "services": r"(emergency care|ambulance|icu|surgery|pharmacy|laboratory|blood bank|casualty|trauma care)",
    "operating_hours": r"(24 ?[/x×] ?7|24 hours?|round[- ]the[- ]clock|[0-9]{1,2} ?(?:am|pm) ?(?:-|to) ?[0-9]{1,2} ?(?:am|pm))",
    "languages": r"(english|hindi|bengali|tamil|telugu|marathi|malayalam|kannada|gujarati|punjabi)",
    "insurance_accepted": r"(ayushman bharat|pm-?jay|cghs|esic|cashless|star health)",
}
