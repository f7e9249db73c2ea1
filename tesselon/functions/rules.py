"""Rule tables as text, one rule a line, in order.  They must stay as they are for results to stay the same."""

# Personal-data types and their patterns.
PII = r"""
ssn ~ \b\d{3}-\d{2}-\d{4}\b
phone ~ \(?\d{3}\)?[\s\-.]\d{3}[\s\-.]\d{4}\b
email ~ \b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b
mrn ~ (?i)\bMRN[:\s]?\s*\d{5,10}\b
dob ~ (?i)\b(?:DOB|Date of Birth|Birth Date)[:\s]+\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b
specific_date ~ (?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b
date_numeric ~ \b\d{1,2}/\d{1,2}/\d{2,4}\b
age_over_89 ~ (?i)\b(9\d|1[01]\d)\s*(?:year|yr)s?\s*old\b
device_id ~ (?i)\b(?:Serial|Device)\s*(?:No|Number|#)[:\s]+[A-Z0-9\-]{6,20}\b
person_name ~ \b(?:Dr\.|Doctor|Physician|Patient|Pt\.?)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})
"""

# What replaces an entity; # stands for the first 8 hex digits of its hash.
PSEUDONYMS = """
ssn ~ [SSN_REDACTED]
phone ~ [PHONE_REDACTED]
email ~ [EMAIL_REDACTED]
mrn ~ [MRN_#]
dob ~ [DOB_REDACTED]
specific_date ~ [DATE]
date_numeric ~ [DATE]
age_over_89 ~ [AGE>89]
device_id ~ [DEVICE_#]
person_name ~ [PERSON_#]
"""

# Personal-data rules of the evaluation variant, in the order they are applied.
EVALUATION_PII = r"""
ssn ~ \b\d{3}-\d{2}-\d{4}\b
phone ~ \(?\d{3}\)?[\s\-\.]\d{3}[\s\-\.]\d{4}\b
email ~ \b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b
mrn ~ (?i)\bMRN[:\s]+\d{5,10}\b
dob ~ (?i)\b(?:DOB|Date of Birth)[:\s]+\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b
spec_date ~ (?i)\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},?\s+\d{4}\b
date_num ~ \b\d{1,2}/\d{1,2}/\d{2,4}\b
age_over_89 ~ (?i)\b(?:9\d|1[01]\d)\s*(?:year|yr)s?\s*old\b
device_id ~ (?i)\bSerial\s*(?:No|#)[:\s]+[A-Z0-9\-]{6,20}\b
name_context ~ \b(?:Dr\.|Patient|Pt\.?)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})
"""

# What replaces them; # stands for the first 8 hex digits of the hash.
EVALUATION_PSEUDONYMS = """
ssn ~ [SSN_REDACTED]
phone ~ [PHONE_REDACTED]
email ~ [EMAIL_REDACTED]
mrn ~ [MRN_#]
dob ~ [DOB_REDACTED]
spec_date ~ [DATE_REDACTED]
date_num ~ [DATE_REDACTED]
age_over_89 ~ [AGE>89]
device_id ~ [DEVICE_#]
name_context ~ [PERSON_#]
"""

# Document types by phrases of the lower-cased text, in the order they are tried; any other is a clinical_note.
DOCUMENT_TYPES = """
discharge_summary ~ discharge summary|discharge note
radiology_report ~ radiology|impression:|findings:|mri|ct scan|x-ray
lab_report ~ lab result|laboratory|specimen|result:
"""

# Kinds of structured records by words of a question, in the order they are tried; any other asks for all.
STRUCTURED_KINDS = """
medications ~ medication|drug|prescription|rx
observations ~ lab|result|test|observation|vital
conditions ~ condition|diagnosis|diagnos|problem
"""

# What a prompt asks for by query type.
TEMPLATES = """
factual_lookup ~ Provide a direct, factual answer.
explanation ~ Explain the reasoning and clinical rationale.
comparison ~ Compare the values/findings, noting changes over time.
multi_hop ~ This requires synthesizing information from multiple documents. Connect the relevant facts logically.
summarization ~ Provide a comprehensive but concise summary organized chronologically.
temporal ~ Focus on events within the specified time period.
"""

# Terms, their synonyms, abbreviations and related terms (two of each are used).
SYNONYMS = """
myocardial infarction ~ heart attack, cardiac infarction ~ MI, AMI ~ chest pain, troponin
heart attack ~ myocardial infarction, cardiac infarction ~ MI, AMI ~ chest pain, troponin
diabetes ~ diabetes mellitus, diabetic ~ DM, T2DM ~ glucose, insulin
hypertension ~ high blood pressure, elevated blood pressure ~ HTN, BP ~ blood pressure, systolic
blood pressure ~ arterial pressure, bp reading ~ BP, SBP ~ hypertension, hypotension
medication ~ drug, medicine ~ med, rx ~ dosage, dose
discharge ~ discharged from hospital, release from hospital ~ d/c ~ discharge summary, discharge medications
lab ~ laboratory, lab result ~ labs ~ specimen, serum
vital signs ~ vitals, vital measurements ~ VS ~ blood pressure, heart rate
heart rate ~ pulse, cardiac rate ~ HR, pulse rate ~ bradycardia, tachycardia
oxygen saturation ~ o2 saturation, spo2 ~ SpO2, O2 sat ~ hypoxia, oxygen therapy
ecg ~ electrocardiogram, ekg ~ EKG, ECG ~ rhythm, qrs
pneumonia ~ lung infection, pulmonary infection ~ PNA ~ chest xray, infiltrate
surgery ~ operation, surgical procedure ~ OR, procedure ~ anesthesia, incision
allergy ~ allergic reaction, hypersensitivity ~ NKDA, NKA ~ anaphylaxis, adverse reaction
"""

# The search analyzer's stop words and synonym groups (the first word stands for a group).
STOPWORDS = "the is at which"
SYNONYM_GROUPS = """
mi, myocardial infarction, heart attack
bp, blood pressure
hr, heart rate
"""

# Seconds a cached answer lives, by query type.
TTL = {"factual_lookup": 3600, "summarization": 1800, "temporal": 900}
TTL_DEFAULT = 3600

# Metric, threshold above (>) or below (<) which an alert is raised, severity.
ALERTS = """
p95_latency_ms > 2000 WARN
pii_leakage_count > 0 CRITICAL
cache_hit_rate < 0.2 INFO
retry_rate > 0.2 WARN
validation_failure_rate > 0.1 ERROR
"""

# Quasi-identifiers (rules of this library).
QUASI_IDENTIFIERS = r"""
age ~ (?i)\b\d{1,3}[ -](?:year|yr)s?[ -]old\b
date ~ \b\d{1,2}/\d{1,2}/\d{2,4}\b
place ~ (?i)\b(?:street|avenue|road|clinic|hospital) of [A-Z][a-z]+
"""

# Query types in the order of precedence, their patterns.
INTENTS = r"""
structured_query ~ \ball\b.*(medication|lab|result|test|value|vital)
structured_query ~ \blist\b.*(medication|lab|diagnosis|condition|procedure)
structured_query ~ \bshow\b.*(lab|result|medication|vital|value)
structured_query ~ \bhow many\b
structured_query ~ \bcount\b
structured_query ~ \blatest\b.*(lab|result|value|vital)
structured_query ~ \bmost recent\b
temporal ~ \bwhen\b
temporal ~ \bon\s+(?:january|february|march|april|may|june|july|august|september|october|november|december)
temporal ~ \bon\s+\d{1,2}/\d{1,2}
temporal ~ \blast\s+(?:week|month|year|day)
temporal ~ \bthis\s+(?:week|month|year)
temporal ~ \bafter\b
temporal ~ \bbefore\b
temporal ~ \btimeline\b
temporal ~ \bchronol
comparison ~ \bcompare\b
comparison ~ \bdifference\b
comparison ~ \bchange\b.*(from|to|over time)
comparison ~ \bhow.*(changed|different|improved|worsened)
comparison ~ \badmission.*discharge
comparison ~ \bdischarge.*admission
comparison ~ \btrend\b
comparison ~ \bover time\b
comparison ~ \bbefore.*after\b
multi_hop ~ \bconsistent\b
multi_hop ~ \brelated to\b
multi_hop ~ \bcaused by\b
multi_hop ~ \bbecause of\b
multi_hop ~ \bconnection between\b
multi_hop ~ \brelationship between\b
multi_hop ~ \bwas the.*(treatment|therapy|medication).*(appropriate|correct|consistent)
multi_hop ~ \bdid.*(lead to|cause|result in)
summarization ~ \bsummar
summarization ~ \boverview\b
summarization ~ \bbrief\b
summarization ~ \bwhat happened\b
summarization ~ \bhospital course\b
summarization ~ \bmedical history\b
summarization ~ \boverall\b
summarization ~ \bin general\b
explanation ~ \bwhy\b
explanation ~ \bhow\b.*(?:was|were|did|does)
explanation ~ \bexplain\b
explanation ~ \breason\b
explanation ~ \breason(?:ing)? for\b
explanation ~ \bindication\b
explanation ~ \bstarted on\b
explanation ~ \bprescribed\b
factual_lookup ~ \bwhat\b.*(medication|drug|diagnosis|condition|test|lab|vital|dose|level)
factual_lookup ~ \bwhich\b
factual_lookup ~ \bwho\b
factual_lookup ~ \bwhat is\b
factual_lookup ~ \bwhat was\b
factual_lookup ~ \btell me\b
factual_lookup ~ \bfind\b
"""

# Query type, route, k, rerank, dense, sparse, latency in ms.
ROUTES = """
factual_lookup hybrid_retrieval 5 true true true 150
explanation hybrid_retrieval 10 true true false 200
comparison hybrid_retrieval 20 true true true 300
multi_hop multi_hop 15 true true true 500
summarization document_level 50 false true true 400
temporal hybrid_retrieval 10 true true true 200
structured_query structured_query 0 false false false 50
"""

# Phrases of an answer that found nothing.
FALLBACK = "not available|not found|no information|cannot find|not in the provided|not mentioned|llm error"

# Abbreviations and what they stand for.
ABBREVIATIONS = r"""
BP ~ blood pressure
HR ~ heart rate
RR ~ respiratory rate
SpO2 ~ oxygen saturation
DM ~ diabetes mellitus
HTN ~ hypertension
MI ~ myocardial infarction
CHF ~ congestive heart failure
COPD ~ chronic obstructive pulmonary disease
DVT ~ deep vein thrombosis
PE ~ pulmonary embolism
UTI ~ urinary tract infection
CAD ~ coronary artery disease
CVA ~ cerebrovascular accident stroke
TIA ~ transient ischemic attack
HbA1c ~ hemoglobin a1c glycated hemoglobin
ECG ~ electrocardiogram
EKG ~ electrocardiogram
MRI ~ magnetic resonance imaging
CT ~ computed tomography
d/c ~ discharge
Rx ~ prescription medication
H&P ~ history and physical
HPI ~ history of present illness
"""

# Section headers of the main and of the evaluation chunker.
HEADERS = "CHIEF COMPLAINT|HISTORY OF PRESENT ILLNESS|HPI|PAST MEDICAL HISTORY|PMH|MEDICATIONS|ALLERGIES|PHYSICAL EXAMINATION|REVIEW OF SYSTEMS|ROS|ASSESSMENT AND PLAN|ASSESSMENT|PLAN|LAB RESULTS|LABORATORY|IMAGING|DISCHARGE SUMMARY|DISCHARGE MEDICATIONS|FOLLOW.UP|SOCIAL HISTORY|FAMILY HISTORY|VITAL SIGNS|IMPRESSION|FINDINGS"
EVALUATION_HEADERS = "CHIEF COMPLAINT|HISTORY OF PRESENT ILLNESS|HPI|PAST MEDICAL HISTORY|MEDICATIONS?(?: ON ADMISSION| AT DISCHARGE)?|ALLERGIES|PHYSICAL EXAMINATION(?: ON ADMISSION)?|VITAL SIGNS?|INVESTIGATIONS?|LABORATORY|LAB(ORATORY)? RESULTS?|HAEMATOLOGY|BIOCHEMISTRY|COAGULATION|HOSPITAL COURSE|ASSESSMENT AND PLAN|ASSESSMENT|PLAN|DISCHARGE CONDITION|DISCHARGE MEDICATIONS?|FOLLOW.UP(?: PLAN)?|DIAGNOS[EI]S|FINDINGS|IMPRESSION|RECOMMENDATION|SUBJECTIVE|OBJECTIVE|NOTES?|EDUCATION TODAY"


# Sentences of prompts, answers, warnings and guards.
NO_CONTEXT = "No relevant context found."
NO_CONTEXT_EVALUATION = "No relevant context retrieved."
ONLY_CONTEXT = "Please answer based solely on the context above."
ONLY_CONTEXT_EVALUATION = "Answer based solely on the context above. Cite source sections."
NOT_AVAILABLE = "The information is not available in the provided records."
NOT_FOUND = "Not found in the provided records."
FROM_RECORDS = "Based on the clinical records: "
LOW_CONFIDENCE = "The retrieved records may not fully address this query. Please verify with the original clinical records."
FAIR_CONFIDENCE = "Consider reviewing source records for complete information."
BLOCKED = "[RESPONSE BLOCKED: PII detected in generated output. Please rephrase your query without requesting personally identifiable information.]"
FAILED = "An error occurred generating the response. Please try again."
GENERATION_ERROR = "LLM generation error"
PII_REASON = "PII types detected: "
PII_WARNING = "PII was sanitized from output: "
ANSWER_TEXTS = {
    "medications": ("medication", "No medication records found for this patient."),
    "observations": ("observation", "No lab/observation records found for this patient."),
    "conditions": ("condition", "No condition/diagnosis records found for this patient."),
}

def rows(table: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ~ ", 1)) for x in table.strip().splitlines()]
