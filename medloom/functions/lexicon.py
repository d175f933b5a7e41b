"""Word lists and lookup tables.

Fixed values: results depend on them, so they are stated as they are, in their natural order.
Tables that a site keeps larger (abbreviations, code aliases) are parameters: `read_pairs` reads
one from a two-column file, and every operator that uses one takes it as an argument. The tables
here are the defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Abbreviation and what it stands for.
ABBREVIATIONS = {
    "pt": "patient", "pts": "patients", "m": "male", "f": "female", "yo": "year old", "y/o": "year old", "dob": "date of birth", "hx": "history", "h/o": "history of",
    "pmh": "past medical history", "psh": "past surgical history", "fh": "family history", "sh": "social history", "fhx": "family history", "cc": "chief complaint",
    "c/o": "complains of", "s/o": "suggestive of", "r/o": "rule out", "w/": "with", "w/o": "without", "s/p": "status post", "sx": "symptoms", "dx": "diagnosis",
    "ddx": "differential diagnosis", "rx": "prescription", "tx": "treatment", "sob": "shortness of breath", "doe": "dyspnea on exertion", "cp": "chest pain", "ha": "headache",
    "n/v": "nausea and vomiting", "abd": "abdominal", "lbp": "lower back pain",
    "bp": "blood pressure", "hr": "heart rate", "rr": "respiratory rate", "temp": "temperature", "spo2": "oxygen saturation", "o2 sat": "oxygen saturation", "bmi": "body mass index",
    "wt": "weight", "ht": "height", "map": "mean arterial pressure",
    "pe": "physical examination", "heent": "head eyes ears nose throat", "cv": "cardiovascular", "resp": "respiratory", "gi": "gastrointestinal", "gu": "genitourinary",
    "neuro": "neurological", "nad": "no acute distress", "wnl": "within normal limits", "rrr": "regular rate and rhythm", "ctab": "clear to auscultation bilaterally",
    "mi": "myocardial infarction", "stemi": "ST elevation myocardial infarction", "nstemi": "non ST elevation myocardial infarction", "chf": "congestive heart failure",
    "cad": "coronary artery disease", "afib": "atrial fibrillation", "svt": "supraventricular tachycardia", "vt": "ventricular tachycardia", "pci": "percutaneous coronary intervention",
    "cabg": "coronary artery bypass grafting", "dvt": "deep vein thrombosis", "htn": "hypertension", "hld": "hyperlipidemia", "lvef": "left ventricular ejection fraction",
    "echo": "echocardiogram", "ecg": "electrocardiogram", "ekg": "electrocardiogram",
    "copd": "chronic obstructive pulmonary disease", "cap": "community acquired pneumonia", "ards": "acute respiratory distress syndrome", "osa": "obstructive sleep apnea",
    "uri": "upper respiratory infection", "pft": "pulmonary function test", "cpap": "continuous positive airway pressure",
    "dm": "diabetes mellitus", "dm1": "type 1 diabetes mellitus", "dm2": "type 2 diabetes mellitus", "t2dm": "type 2 diabetes mellitus", "t1dm": "type 1 diabetes mellitus",
    "hba1c": "hemoglobin A1c", "tsh": "thyroid stimulating hormone", "t3": "triiodothyronine", "t4": "thyroxine", "hypo": "hypothyroidism", "hyper": "hyperthyroidism",
    "cva": "cerebrovascular accident", "tia": "transient ischemic attack", "loc": "loss of consciousness", "gcs": "glasgow coma scale", "mri": "magnetic resonance imaging",
    "ct": "computed tomography", "eeg": "electroencephalogram", "ms": "multiple sclerosis", "sz": "seizure", "ams": "altered mental status",
    "aki": "acute kidney injury", "ckd": "chronic kidney disease", "esrd": "end stage renal disease", "bun": "blood urea nitrogen", "cr": "creatinine",
    "egfr": "estimated glomerular filtration rate", "hd": "hemodialysis", "uti": "urinary tract infection", "ua": "urinalysis",
    "gerd": "gastroesophageal reflux disease", "ibs": "irritable bowel syndrome", "ibd": "inflammatory bowel disease", "cd": "crohn's disease", "uc": "ulcerative colitis",
    "cbc": "complete blood count", "bmp": "basic metabolic panel", "cmp": "comprehensive metabolic panel", "lft": "liver function tests", "lfts": "liver function tests",
    "inr": "international normalized ratio", "ptt": "partial thromboplastin time", "wbc": "white blood cell count", "rbc": "red blood cell count", "hgb": "hemoglobin",
    "hct": "hematocrit", "plt": "platelet count", "na": "sodium", "k": "potassium", "cl": "chloride", "co2": "carbon dioxide", "ca": "calcium", "phos": "phosphorus",
    "alt": "alanine aminotransferase", "ast": "aspartate aminotransferase", "alp": "alkaline phosphatase", "ldl": "low density lipoprotein", "hdl": "high density lipoprotein",
    "tg": "triglycerides", "ck": "creatine kinase", "trop": "troponin", "bnp": "brain natriuretic peptide", "crp": "c-reactive protein", "esr": "erythrocyte sedimentation rate",
    "po": "by mouth", "iv": "intravenous", "im": "intramuscular", "sc": "subcutaneous", "sl": "sublingual", "top": "topical", "inh": "inhaled", "pr": "per rectum",
    "ng": "nasogastric", "prn": "as needed", "qd": "once daily", "bid": "twice daily", "tid": "three times daily", "qid": "four times daily", "qhs": "at bedtime",
    "q4h": "every four hours", "q6h": "every six hours", "q8h": "every eight hours", "q12h": "every twelve hours", "ac": "before meals", "pc": "after meals",
    "stat": "immediately", "mg": "milligrams", "mcg": "micrograms", "gm": "grams", "ml": "milliliters", "mEq": "milliequivalents",
    "chemo": "chemotherapy", "bx": "biopsy", "mets": "metastases", "all": "acute lymphoblastic leukemia",
    "cxr": "chest x-ray", "us": "ultrasound", "lp": "lumbar puncture", "or": "operating room", "icu": "intensive care unit", "ed": "emergency department", "er": "emergency room",
    "dc": "discharge", "d/c": "discharge", "f/u": "follow up", "npo": "nothing by mouth",
    "hiv": "human immunodeficiency virus", "mrsa": "methicillin resistant staphylococcus aureus", "abx": "antibiotics", "cx": "culture", "bc": "blood culture",
    "yom": "year old male", "yof": "year old female", "n/v/d": "nausea vomiting and diarrhea", "msk": "musculoskeletal", "a&o": "alert and oriented",
    "a&ox3": "alert and oriented times three", "nab": "no abnormality detected", "ntnd": "non-tender non-distended", "vf": "ventricular fibrillation",
    "pe_d": "pulmonary embolism", "hap": "hospital acquired pneumonia", "lri": "lower respiratory infection", "fev1": "forced expiratory volume in one second",
    "fvc": "forced vital capacity", "bipap": "bilevel positive airway pressure", "intub": "intubation", "fbs": "fasting blood sugar", "rbs": "random blood sugar",
    "lgib": "lower gastrointestinal bleed", "ugib": "upper gastrointestinal bleed", "egd": "esophagogastroduodenoscopy", "pt_lab": "prothrombin time",
    "tbili": "total bilirubin", "dbili": "direct bilirubin", "psa": "prostate specific antigen", "sos": "if needed", "ca_onc": "cancer", "xrt": "radiation therapy",
    "nhl": "non-hodgkin lymphoma", "hl": "hodgkin lymphoma", "aml": "acute myeloid leukemia", "cml": "chronic myeloid leukemia", "kub": "kidney ureter bladder x-ray",
    "echo_p": "echocardiography", "adm": "admission", "ama": "against medical advice", "tpn": "total parenteral nutrition", "picc": "peripherally inserted central catheter",
    "cvl": "central venous line", "foley": "foley catheter", "aids": "acquired immunodeficiency syndrome", "hbv": "hepatitis B virus", "hcv": "hepatitis C virus",
    "vre": "vancomycin resistant enterococcus", "ssti": "skin and soft tissue infection",
}

# Section headers.
SECTION_HEADERS = [
    "chief complaint", "history of present illness", "hpi", "past medical history", "pmh", "past surgical history", "family history", "social history", "review of systems", "ros",
    "medications", "allergies", "physical examination", "vital signs", "general", "cardiovascular", "respiratory", "abdomen", "neurological", "assessment", "plan",
    "assessment and plan", "impression", "diagnosis", "discharge summary", "discharge medications", "follow up", "laboratory results", "imaging", "procedures",
]

# Labels of tagging models and the labels used here.
ENTITY_LABELS = {
    "DISEASE": "DISEASE", "CHEMICAL": "DRUG", "CANCER": "DISEASE", "CELL_TYPE": "BODY_PART", "CELL_LINE": "BODY_PART", "DNA": "LAB_VALUE", "PROTEIN": "DRUG", "RNA": "LAB_VALUE",
    "B-Disease": "DISEASE", "I-Disease": "DISEASE", "B-Chemical": "DRUG", "I-Chemical": "DRUG",
    "PERSON": "PERSON", "DATE": "DATE", "GPE": "LOCATION", "ORG": "ORGANIZATION", "CARDINAL": "NUMBER",
}

# Names before a dose that aren't medications.
NOT_DRUGS = [
    "oxygen", "air", "water", "blood", "glucose", "cholesterol", "sodium", "potassium", "calcium", "magnesium", "protein", "hemoglobin", "bilirubin", "creatinine", "lactate",
    "albumin", "carbon", "nitrogen", "phosphorus", "iron", "zinc", "fiber", "the", "a", "an", "this", "that", "he", "she", "patient", "room", "normal", "saline", "contrast", "dye", "food",
]

# First words of names that aren't medications.
NOT_FIRST = [
    "the", "on", "and", "or", "of", "in", "at", "to", "for", "by", "an", "as", "is", "it", "he", "she", "was", "has", "had", "are", "were", "been", "with", "from", "this", "that",
    "these", "those", "continue", "started", "added", "hold", "resume", "take", "use",
]

# Spelt-out units and their short forms.
UNITS = {"milligrams": "mg", "milligram": "mg", "micrograms": "mcg", "microgram": "mcg", "grams": "g", "gram": "g", "milliliters": "ml", "milliliter": "ml", "units": "units", "unit": "units"}

# Symptoms and procedures.
SYMPTOMS = [
    "chest pain", "shortness of breath", "dyspnea", "nausea", "vomiting", "diarrhea", "headache", "dizziness", "fatigue", "weakness", "fever", "chills", "cough", "wheezing",
    "palpitations", "syncope", "edema", "swelling", "pain", "ache", "discomfort", "numbness", "tingling", "blurred vision", "confusion", "anxiety", "depression", "insomnia",
    "abdominal pain", "back pain", "joint pain", "muscle pain", "sore throat", "runny nose", "nasal congestion", "loss of appetite", "weight loss", "weight gain", "polyuria",
    "polydipsia", "polyphagia", "constipation",
]
PROCEDURES = [
    "echocardiogram", "electrocardiogram", "coronary angiography", "percutaneous coronary intervention", "coronary artery bypass", "computed tomography",
    "magnetic resonance imaging", "ultrasound", "chest x-ray", "lumbar puncture", "colonoscopy", "endoscopy", "biopsy", "surgery", "intubation", "catheterization", "hemodialysis",
    "blood transfusion", "chemotherapy", "radiation therapy",
]

# Keywords that make a sentence weigh more; a repeated one counts twice.
CLINICAL_KEYWORDS = [
    "diagnosis", "diagnosed", "assessment", "impression", "consistent with", "suggestive of", "confirmed", "ruled out", "presents with", "critical", "severe", "acute", "emergent",
    "urgent", "significant", "elevated", "decreased", "abnormal", "positive", "negative", "treatment", "plan", "prescribed", "started", "initiated", "administered", "referred",
    "scheduled", "recommended", "ordered", "myocardial infarction", "stemi", "nstemi", "chest pain", "troponin", "ejection fraction", "ecg", "electrocardiogram", "angiography",
    "diabetes", "hypertension", "pneumonia", "heart failure", "sepsis", "stroke", "cancer", "infection", "fracture", "pulmonary embolism", "hemoglobin", "creatinine", "troponin",
    "hba1c", "sodium", "potassium", "white blood cell", "platelet", "glucose", "bilirubin", "aspirin", "heparin", "insulin", "metformin", "lisinopril", "statin", "antibiotic",
    "warfarin", "metoprolol", "furosemide",
]

# Weights of sections; others weigh 0.5.
SECTION_PRIORITY = {
    "assessment and plan": 1.0, "assessment": 1.0, "plan": 0.95, "impression": 0.95, "history of present illness": 0.85, "hpi": 0.85, "chief complaint": 0.80,
    "laboratory results": 0.75, "imaging": 0.70, "procedures": 0.70, "physical examination": 0.60, "medications": 0.65, "discharge summary": 0.90, "past medical history": 0.50,
    "social history": 0.30, "family history": 0.30, "review of systems": 0.40,
}

# Parts of names that are symptoms or substances rather than diagnoses in a note.
NOT_DIAGNOSES = [
    "pain", "chest pain", "shortness", "breath", "nausea", "vomiting", "diarrhea", "headache", "dizziness", "fatigue", "weakness", "fever", "cough", "diaphoresis", "sweating",
    "swelling", "edema", "syncope", "confusion", "palpitation", "oxygen", "cholesterol", "glucose", "sodium", "potassium", "air", "blood", "room", "water", "protein",
]

# Words that speak for a medical text.
INDICATORS = ["patient", "diagnosis", "treatment", "medication", "symptom", "history", "blood", "pain", "mg", "doctor"]

# Diseases that a symptom speaks for.
SYMPTOM_DISEASES = {
    "chest pain": ["myocardial infarction", "angina", "pericarditis", "pulmonary embolism"],
    "shortness of breath": ["heart failure", "pulmonary embolism", "pneumonia", "asthma", "COPD"],
    "dyspnea": ["heart failure", "pulmonary embolism", "pneumonia"],
    "palpitations": ["atrial fibrillation", "supraventricular tachycardia", "anxiety"],
    "diaphoresis": ["myocardial infarction", "hypoglycemia", "sepsis"],
    "syncope": ["arrhythmia", "vasovagal syncope", "aortic stenosis"],
    "leg swelling": ["deep vein thrombosis", "heart failure", "venous insufficiency"],
    "edema": ["heart failure", "renal failure", "liver failure"],
    "headache": ["migraine", "hypertension", "meningitis", "subarachnoid hemorrhage"],
    "dizziness": ["benign paroxysmal positional vertigo", "orthostatic hypotension", "stroke"],
    "confusion": ["encephalopathy", "stroke", "delirium", "dementia"],
    "weakness": ["stroke", "multiple sclerosis", "Guillain-Barre syndrome"],
    "numbness": ["stroke", "peripheral neuropathy", "multiple sclerosis"],
    "seizure": ["epilepsy", "brain tumor", "metabolic encephalopathy"],
    "cough": ["pneumonia", "COPD", "asthma", "heart failure", "GERD"],
    "wheezing": ["asthma", "COPD", "heart failure", "anaphylaxis"],
    "hemoptysis": ["tuberculosis", "lung cancer", "pulmonary embolism"],
    "nausea": ["myocardial infarction", "gastroenteritis", "pancreatitis"],
    "vomiting": ["gastroenteritis", "bowel obstruction", "increased intracranial pressure"],
    "abdominal pain": ["appendicitis", "pancreatitis", "cholecystitis", "peptic ulcer"],
    "diarrhea": ["infectious gastroenteritis", "inflammatory bowel disease", "C. difficile"],
    "polyuria": ["diabetes mellitus", "diabetes insipidus", "hypercalcemia"],
    "polydipsia": ["diabetes mellitus", "diabetes insipidus"],
    "weight loss": ["cancer", "diabetes mellitus", "hyperthyroidism", "tuberculosis"],
    "fatigue": ["anemia", "hypothyroidism", "heart failure", "cancer", "depression"],
    "fever": ["infection", "sepsis", "malignancy", "autoimmune disease"],
}

# Diseases that a drug treats.
DRUG_DISEASES = {
    "aspirin": ["stroke prevention", "transient ischemic attack"],
    "clopidogrel": ["myocardial infarction", "stroke", "peripheral artery disease"],
    "heparin": ["deep vein thrombosis", "pulmonary embolism", "myocardial infarction"],
    "warfarin": ["atrial fibrillation", "deep vein thrombosis", "pulmonary embolism"],
    "metoprolol": ["hypertension", "heart failure", "myocardial infarction", "atrial fibrillation"],
    "atenolol": ["hypertension", "angina", "atrial fibrillation"],
    "lisinopril": ["hypertension", "heart failure", "diabetic nephropathy"],
    "enalapril": ["hypertension", "heart failure"],
    "amlodipine": ["hypertension", "angina"],
    "atorvastatin": ["hyperlipidemia", "cardiovascular disease prevention"],
    "rosuvastatin": ["hyperlipidemia", "cardiovascular disease prevention"],
    "furosemide": ["heart failure", "edema", "hypertension"],
    "nitroglycerin": ["angina", "myocardial infarction", "hypertensive emergency"],
    "metformin": ["type 2 diabetes mellitus"],
    "insulin": ["type 1 diabetes mellitus", "type 2 diabetes mellitus", "diabetic ketoacidosis"],
    "empagliflozin": ["type 2 diabetes mellitus", "heart failure", "chronic kidney disease"],
    "sitagliptin": ["type 2 diabetes mellitus"],
    "glipizide": ["type 2 diabetes mellitus"],
    "albuterol": ["asthma", "COPD", "bronchospasm"],
    "salbutamol": ["asthma", "COPD"],
    "tiotropium": ["COPD"],
    "prednisone": ["asthma", "COPD exacerbation", "autoimmune disease"],
    "amoxicillin": ["bacterial pneumonia", "urinary tract infection", "sinusitis"],
    "azithromycin": ["community-acquired pneumonia", "atypical pneumonia"],
    "vancomycin": ["MRSA infection", "C. difficile"],
    "ciprofloxacin": ["urinary tract infection", "pneumonia", "gastrointestinal infection"],
    "levodopa": ["Parkinson's disease"],
    "donepezil": ["Alzheimer's disease", "dementia"],
}

# Diseases that a laboratory value indicates.
LAB_DISEASES = {
    "troponin": ["myocardial infarction", "myocarditis", "pulmonary embolism"],
    "hba1c": ["diabetes mellitus control", "pre-diabetes"],
    "bnp": ["heart failure", "cardiac dysfunction"],
    "creatinine": ["acute kidney injury", "chronic kidney disease"],
    "white blood cell count": ["infection", "leukemia", "inflammation"],
    "hemoglobin": ["anemia"],
    "ldl": ["hyperlipidemia", "cardiovascular risk"],
    "tsh": ["hypothyroidism", "hyperthyroidism"],
    "inr": ["anticoagulation status", "liver function"],
    "crp": ["inflammation", "infection", "sepsis"],
    "glucose": ["diabetes mellitus", "hypoglycemia"],
}

# Complications of a disease. An upper-case name never meets lower-case text.
COMPLICATIONS = {
    "diabetes mellitus": ["diabetic nephropathy", "diabetic retinopathy", "peripheral neuropathy", "cardiovascular disease"],
    "hypertension": ["stroke", "myocardial infarction", "heart failure", "chronic kidney disease", "aortic dissection"],
    "myocardial infarction": ["heart failure", "arrhythmia", "cardiogenic shock", "ventricular rupture"],
    "heart failure": ["pulmonary edema", "renal failure", "atrial fibrillation"],
    "atrial fibrillation": ["stroke", "heart failure", "thromboembolism"],
    "COPD": ["respiratory failure", "pulmonary hypertension", "cor pulmonale", "pneumonia"],
}

# Code, description, category and aliases of diagnoses.
CODES = [
    ("I10", "Essential (primary) hypertension", "Cardiovascular", ["hypertension", "htn", "high blood pressure", "elevated blood pressure"]),
    ("I11.9", "Hypertensive heart disease without heart failure", "Cardiovascular", ["hypertensive heart disease", "hypertensive cardiomyopathy"]),
    ("I21.0", "ST elevation myocardial infarction of anterior wall", "Cardiovascular", ["anterior stemi", "anterior mi", "anterior wall mi", "anterior myocardial infarction", "lad occlusion"]),
    ("I21.19", "ST elevation myocardial infarction of inferior wall", "Cardiovascular", ["inferior stemi", "inferior mi", "inferior wall mi", "inferior myocardial infarction", "rca occlusion", "inferior st elevation myocardial infarction"]),
    ("I21.4", "Non-ST elevation myocardial infarction", "Cardiovascular", ["nstemi", "non st elevation mi", "non-st elevation myocardial infarction", "non-stemi"]),
    ("I21.9", "Acute myocardial infarction, unspecified", "Cardiovascular", ["myocardial infarction", "mi", "heart attack", "acute mi", "acute myocardial infarction", "stemi"]),
    ("I25.10", "Atherosclerotic heart disease of native coronary artery", "Cardiovascular", ["coronary artery disease", "cad", "ischemic heart disease", "coronary atherosclerosis", "atherosclerotic heart disease"]),
    ("I48.0", "Paroxysmal atrial fibrillation", "Cardiovascular", ["paroxysmal afib", "paroxysmal atrial fibrillation"]),
    ("I48.11", "Longstanding persistent atrial fibrillation", "Cardiovascular", ["persistent afib", "chronic atrial fibrillation", "permanent atrial fibrillation"]),
    ("I48.91", "Unspecified atrial fibrillation", "Cardiovascular", ["atrial fibrillation", "afib", "a fib", "af"]),
    ("I50.9", "Heart failure, unspecified", "Cardiovascular", ["heart failure", "chf", "congestive heart failure", "cardiac failure", "hf"]),
    ("I50.32", "Chronic diastolic (congestive) heart failure", "Cardiovascular", ["diastolic heart failure", "hfpef", "heart failure preserved ejection"]),
    ("I50.22", "Chronic systolic (congestive) heart failure", "Cardiovascular", ["systolic heart failure", "hfref", "reduced ejection fraction heart failure"]),
    ("I26.99", "Other pulmonary embolism without acute cor pulmonale", "Cardiovascular", ["pulmonary embolism", "pe", "pulmonary thromboembolism", "pulmonary embolus"]),
    ("I82.401", "Acute deep vein thrombosis of unspecified deep veins of right lower extremity", "Cardiovascular", ["deep vein thrombosis", "dvt", "deep venous thrombosis", "lower extremity dvt"]),
    ("I63.9", "Cerebral infarction, unspecified", "Cardiovascular", ["stroke", "cerebrovascular accident", "cva", "ischemic stroke", "cerebral infarction", "brain attack"]),
    ("I64", "Stroke, not specified as haemorrhage or infarction", "Cardiovascular", ["stroke unspecified", "tia vs stroke", "cerebrovascular disease"]),
    ("G45.9", "Transient cerebral ischaemic attack, unspecified", "Neurological", ["tia", "transient ischemic attack", "mini stroke", "transient cerebral ischemia"]),
    ("I71.4", "Abdominal aortic aneurysm, without rupture", "Cardiovascular", ["aortic aneurysm", "abdominal aortic aneurysm", "aaa"]),
    ("E11.9", "Type 2 diabetes mellitus without complications", "Endocrine", ["type 2 diabetes", "t2dm", "type 2 diabetes mellitus", "diabetes mellitus type 2", "dm2", "adult onset diabetes", "non-insulin dependent diabetes"]),
    ("E11.65", "Type 2 diabetes mellitus with hyperglycemia", "Endocrine", ["type 2 diabetes with hyperglycemia", "uncontrolled diabetes", "poorly controlled diabetes", "poorly controlled type 2 diabetes"]),
    ("E11.40", "Type 2 diabetes mellitus with diabetic neuropathy, unspecified", "Endocrine", ["diabetic neuropathy", "peripheral diabetic neuropathy", "diabetes with neuropathy"]),
    ("E11.319", "Type 2 diabetes mellitus with unspecified diabetic retinopathy", "Endocrine", ["diabetic retinopathy", "diabetes with retinopathy"]),
    ("E11.22", "Type 2 diabetes mellitus with diabetic chronic kidney disease", "Endocrine", ["diabetic nephropathy", "diabetic kidney disease", "diabetes with chronic kidney disease"]),
    ("E10.9", "Type 1 diabetes mellitus without complications", "Endocrine", ["type 1 diabetes", "t1dm", "type 1 diabetes mellitus", "juvenile diabetes", "insulin dependent diabetes"]),
    ("E13.65", "Other specified diabetes mellitus with hyperglycemia", "Endocrine", ["diabetes mellitus", "diabetes", "dm", "unspecified diabetes"]),
    ("E78.5", "Hyperlipidemia, unspecified", "Endocrine", ["hyperlipidemia", "high cholesterol", "dyslipidemia", "hypercholesterolemia", "elevated lipids", "high ldl"]),
    ("E78.00", "Pure hypercholesterolemia, unspecified", "Endocrine", ["pure hypercholesterolemia", "familial hypercholesterolemia", "elevated cholesterol"]),
    ("E03.9", "Hypothyroidism, unspecified", "Endocrine", ["hypothyroidism", "underactive thyroid", "low thyroid"]),
    ("E05.90", "Thyrotoxicosis, unspecified, without thyrotoxic crisis", "Endocrine", ["hyperthyroidism", "overactive thyroid", "thyrotoxicosis", "graves disease"]),
    ("E66.9", "Obesity, unspecified", "Endocrine", ["obesity", "morbid obesity", "bmi over 30"]),
    ("J18.9", "Pneumonia, unspecified organism", "Respiratory", ["pneumonia", "community acquired pneumonia", "cap", "lung infection", "pneumonitis"]),
    ("J44.1", "Chronic obstructive pulmonary disease with acute exacerbation", "Respiratory", ["copd exacerbation", "acute copd", "acute exacerbation copd", "aecopd", "copd flare"]),
    ("J44.9", "Chronic obstructive pulmonary disease, unspecified", "Respiratory", ["copd", "chronic obstructive pulmonary disease", "emphysema", "chronic bronchitis"]),
    ("J45.901", "Unspecified asthma with acute exacerbation", "Respiratory", ["asthma exacerbation", "asthma attack", "acute asthma"]),
    ("J45.909", "Unspecified asthma, uncomplicated", "Respiratory", ["asthma", "bronchial asthma", "reactive airway disease"]),
    ("J96.00", "Acute respiratory failure, unspecified whether with hypoxia or hypercapnia", "Respiratory", ["acute respiratory failure", "arf", "respiratory failure", "hypoxic respiratory failure"]),
    ("G47.33", "Obstructive sleep apnea", "Neurological", ["obstructive sleep apnea", "osa", "sleep apnea", "sleep disordered breathing"]),
    ("N17.9", "Acute kidney injury, unspecified", "Renal", ["acute kidney injury", "aki", "acute renal failure", "acute kidney failure", "arf renal"]),
    ("N18.3", "Chronic kidney disease, stage 3", "Renal", ["chronic kidney disease stage 3", "ckd stage 3", "ckd 3"]),
    ("N18.9", "Chronic kidney disease, unspecified", "Renal", ["chronic kidney disease", "ckd", "chronic renal failure", "chronic renal insufficiency", "renal insufficiency"]),
    ("N39.0", "Urinary tract infection, site not specified", "Renal", ["urinary tract infection", "uti", "bladder infection", "cystitis", "urosepsis"]),
    ("K21.0", "Gastro-esophageal reflux disease with oesophagitis", "GI", ["gerd", "gastroesophageal reflux", "acid reflux", "reflux esophagitis", "heartburn"]),
    ("K29.70", "Gastritis, unspecified, without bleeding", "GI", ["gastritis", "stomach inflammation"]),
    ("K92.1", "Melena", "GI", ["gi bleed", "gastrointestinal bleed", "lower gi bleed", "upper gi bleed", "gastrointestinal hemorrhage"]),
    ("K50.90", "Crohn's disease of small intestine, unspecified", "GI", ["crohns disease", "crohn disease", "regional enteritis"]),
    ("K51.90", "Ulcerative colitis, unspecified", "GI", ["ulcerative colitis", "uc", "colitis"]),
    ("K80.20", "Calculus of gallbladder without cholecystitis", "GI", ["gallstones", "cholelithiasis", "gallbladder stones"]),
    ("K85.9", "Acute pancreatitis, unspecified", "GI", ["pancreatitis", "acute pancreatitis"]),
    ("A41.9", "Sepsis, unspecified organism", "Infectious", ["sepsis", "septicemia", "blood poisoning", "bacteremia"]),
    ("A41.51", "Sepsis due to Escherichia coli", "Infectious", ["e coli sepsis", "gram negative sepsis", "urosepsis"]),
    ("B20", "Human immunodeficiency virus disease", "Infectious", ["hiv", "aids", "hiv disease", "human immunodeficiency virus"]),
    ("J12.89", "Other viral pneumonia", "Infectious", ["viral pneumonia", "covid pneumonia", "covid-19 pneumonia"]),
    ("G20", "Parkinson's disease", "Neurological", ["parkinsons disease", "parkinson disease", "parkinsonism"]),
    ("G30.9", "Alzheimer's disease, unspecified", "Neurological", ["alzheimers disease", "alzheimer disease", "dementia alzheimer"]),
    ("F03.90", "Unspecified dementia without behavioral disturbance", "Neurological", ["dementia", "cognitive impairment", "memory loss dementia"]),
    ("G40.909", "Epilepsy, unspecified, not intractable", "Neurological", ["epilepsy", "seizure disorder", "seizures"]),
    ("G35", "Multiple sclerosis", "Neurological", ["multiple sclerosis", "ms", "demyelinating disease"]),
    ("F32.9", "Major depressive disorder, single episode, unspecified", "Mental Health", ["depression", "major depression", "major depressive disorder", "depressive disorder", "mdd"]),
    ("F41.1", "Generalized anxiety disorder", "Mental Health", ["anxiety", "generalized anxiety", "anxiety disorder", "gad"]),
    ("F20.9", "Schizophrenia, unspecified", "Mental Health", ["schizophrenia", "psychosis", "psychotic disorder"]),
    ("C34.90", "Malignant neoplasm of unspecified bronchus and lung", "Oncology", ["lung cancer", "lung carcinoma", "pulmonary malignancy", "bronchogenic carcinoma"]),
    ("C50.919", "Malignant neoplasm of unspecified site of breast", "Oncology", ["breast cancer", "breast carcinoma", "breast malignancy"]),
    ("C61", "Malignant neoplasm of prostate", "Oncology", ["prostate cancer", "prostate carcinoma"]),
    ("C18.9", "Malignant neoplasm of colon, unspecified", "Oncology", ["colon cancer", "colorectal cancer", "colon carcinoma"]),
    ("M16.9", "Osteoarthritis of hip, unspecified", "Musculoskeletal", ["hip osteoarthritis", "hip arthritis", "degenerative hip"]),
    ("M17.9", "Osteoarthritis of knee, unspecified", "Musculoskeletal", ["knee osteoarthritis", "knee arthritis", "degenerative knee"]),
    ("M79.3", "Panniculitis", "Musculoskeletal", ["back pain", "lower back pain", "lbp", "lumbar pain"]),
    ("M06.9", "Rheumatoid arthritis, unspecified", "Musculoskeletal", ["rheumatoid arthritis", "ra", "inflammatory arthritis"]),
    ("D64.9", "Anaemia, unspecified", "Hematology", ["anemia", "anaemia", "low hemoglobin", "iron deficiency anemia"]),
    ("D69.6", "Thrombocytopenia, unspecified", "Hematology", ["thrombocytopenia", "low platelets", "low platelet count"]),
    ("R07.9", "Chest pain, unspecified", "Symptoms", ["chest pain", "chest discomfort", "thoracic pain"]),
    ("R06.00", "Dyspnea, unspecified", "Symptoms", ["shortness of breath", "dyspnea", "breathlessness", "difficulty breathing"]),
    ("R55", "Syncope and collapse", "Symptoms", ["syncope", "fainting", "loss of consciousness", "collapse"]),
    ("R51", "Headache, unspecified", "Symptoms", ["headache", "cephalgia", "head pain"]),
    ("R11.2", "Nausea with vomiting, unspecified", "Symptoms", ["nausea and vomiting", "nausea", "vomiting"]),
    ("R50.9", "Fever, unspecified", "Symptoms", ["fever", "pyrexia", "high temperature", "febrile"]),
    ("Z87.891", "Personal history of nicotine dependence", "History", ["former smoker", "ex smoker", "tobacco use history", "smoking history"]),
    ("Z82.49", "Family history of ischaemic heart disease", "History", ["family history of heart disease", "family history cad", "family history myocardial infarction"]),
    ("Z79.4", "Long-term (current) use of insulin", "History", ["on insulin", "insulin dependent", "insulin therapy", "long term insulin"]),
]

# Qualifiers that are left out to find an alias; words that don't tell diagnoses apart.
QUALIFIERS = [" mellitus", " disease", " disorder", " syndrome", " type"]
STOP_WORDS = ["the", "a", "an", "of", "with", "without", "and", "or", "in", "at", "to", "for", "is", "was", "be", "been", "unspecified", "acute", "chronic", "primary", "secondary"]

# Colours of relations.
COLOURS = {
    "SYMPTOM_OF": "#FF6B6B", "TREATS": "#4ECDC4", "TREATED_BY": "#4ECDC4", "INDICATES": "#DDA0DD", "CAUSED_BY": "#FFA07A", "COMPLICATION_OF": "#FFD700",
    "POTENTIAL_COMPLICATION_OF": "#FFD700", "MONITORS": "#87CEEB", "ALLERGIC_TO": "#FF4500", "DIAGNOSED_WITH": "#98FB98", "CONTRAINDICATES": "#DC143C",
}


def read_pairs(spark: SparkSession, path: str) -> dict[str, str]:
    """A table of keys and values from a CSV file without a header; the last of equal keys wins.
    It is meant for tables of some hundred rows."""
    rows = spark.read.csv(path, schema="key string, value string").collect()
    return {r["key"]: r["value"] for r in rows}


def alias_codes(codes=CODES) -> dict[str, str]:
    """Alias and code; a later code takes over an alias."""
    return {a.lower().strip(): c[0] for c in codes for a in c[3]}


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of constants."""
    return spark.createDataFrame(rows, schema)
