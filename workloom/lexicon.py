"""Word lists, lookup maps and thresholds.

Fixed values: everything in this module is data that the results depend on, kept
as plain text in its natural order. Order matters wherever a "first match wins"
rule reads a list.
"""

# --- column vocabulary -----------------------------------------------------
COLUMN_SYNONYMS = {
    "job_title": ["title", "job_title", "position", "role", "Job Title"],
    "company": ["company", "company_name", "employer", "Company Name"],
    "location": ["location", "city", "address", "Location"],
    "salary": ["salary", "salary_estimate", "compensation", "Salary Estimate"],
    "experience": ["experience", "exp", "years_exp", "experience_required"],
    "skills": ["skills", "skill", "required_skills", "skill_abr"],
    "job_description": ["description", "job_description", "desc", "Job Description"],
    "company_id": ["company_id", "id", "employer_id"],
    "company_size": ["company_size", "size", "employees", "Size"],
    "industry": ["industry", "sector", "domain", "Industry", "Sector"],
    "founded": ["founded", "established", "Founded"],
    "headquarters": ["headquarters", "hq", "Headquarters"],
    "country_code": ["CountryCode", "country_code", "country"],
    "series_code": ["SeriesCode", "series_code", "indicator"],
    "year": ["year", "time", "date", "period"],
    "value": ["value", "data", "count", "percentage"],
    "user_id": ["user_id", "id", "profile_id"],
    "age": ["age", "years"],
    "education": ["education", "qualification", "degree"],
    "gender": ["gender", "sex"],
}

COLUMN_TYPES = {
    "company_id": "bigint", "job_id": "bigint", "user_id": "string",
    "salary_min": "double", "salary_max": "double",
    "experience_min": "double", "experience_max": "double",
    "age": "bigint", "founded": "bigint", "year": "bigint", "value": "double",
}

# Renames per kind of table; the kind is read off the table name.
KIND_RENAMES = {
    "job": {
        "jobtitle": "job_title", "companyname": "company",
        "salaryestimate": "salary_estimate", "jobdescription": "job_description",
        "rating": "company_rating", "typeofownership": "ownership_type",
        "revenue": "company_revenue",
    },
    "company": {
        "name": "company_name", "companysize": "company_size",
        "zipcode": "zip_code", "url": "company_url",
    },
    "gender": {
        "countrycode": "country_code", "seriescode": "series_code",
        "description": "indicator_description",
    },
    "salary": {
        "minsalary": "salary_min", "maxsalary": "salary_max", "avgsalary": "salary_avg",
        "hourly": "is_hourly", "employerprovided": "employer_provided",
    },
}

# --- cleaning --------------------------------------------------------------
TITLE_ABBREVIATIONS = {
    "Jr.": "Junior", "Sr.": "Senior", "Mgr": "Manager", "Mgmt": "Management",
    "Assoc": "Associate", "Asst": "Assistant", "Dev": "Developer", "Eng": "Engineer",
    "Tech": "Technical", "Ops": "Operations", "Hr": "HR", "It": "IT",
    "Ui": "UI", "Ux": "UX", "Ai": "AI", "Ml": "ML",
}

CITY_SYNONYMS = {
    "bengaluru": "bangalore", "mumbai": "mumbai", "delhi ncr": "delhi",
    "new delhi": "delhi", "gurgaon": "gurugram", "noida": "noida", "pune": "pune",
    "hyderabad": "hyderabad", "chennai": "chennai", "kolkata": "kolkata",
    "ahmedabad": "ahmedabad", "kochi": "kochi", "coimbatore": "coimbatore",
    "indore": "indore", "jaipur": "jaipur", "chandigarh": "chandigarh",
}

COMPANY_SUFFIXES = {
    "ltd": ["ltd", "limited", "ltd.", "limited."],
    "pvt": ["pvt", "private", "pvt.", "private."],
    "inc": ["inc", "incorporated", "inc."],
    "corp": ["corp", "corporation", "corp."],
    "llp": ["llp", "limited liability partnership"],
    "llc": ["llc", "limited liability company"],
}

SKILL_BRANDS = {
    "Javascript": "JavaScript", "Nodejs": "Node.js", "Reactjs": "React.js",
    "Vuejs": "Vue.js", "Mysql": "MySQL", "Postgresql": "PostgreSQL",
    "Mongodb": "MongoDB", "Aws": "AWS", "Css3": "CSS3", "Html5": "HTML5",
    "C++": "C++", "C#": "C#", "Php": "PHP",
}

DUPLICATE_KEYS = ["job_title", "company", "company_name", "location"]

COMPARISON_REWRITES = [
    ("pvt ltd", ""), ("private limited", ""), ("ltd", ""), ("inc", ""),
    ("corporation", ""), ("corp", ""), ("company", ""), ("co", ""),
    ("&", "and"), ("@", "at"),
]

# --- salary text -----------------------------------------------------------
FX_TO_INR = {"USD": 83.0, "EUR": 90.0, "GBP": 105.0, "INR": 1.0, "CAD": 62.0, "AUD": 55.0}

CURRENCY_MARKS = {
    "INR": ["₹", "inr", "rupees", "lacs", "lakhs", "lpa", "crores"],
    "USD": ["$", "usd", "dollars", "dollar"],
    "EUR": ["€", "eur", "euros", "euro"],
    "GBP": ["£", "gbp", "pounds", "pound"],
    "CAD": ["cad", "canadian"],
    "AUD": ["aud", "australian"],
}

UNDISCLOSED_PHRASES = [
    "not disclosed", "confidential", "competitive", "negotiable", "based on experience",
    "market rate", "as per company norms", "undisclosed", "not specified", "tbd",
    "to be decided",
]

# (pattern, is a range, multiplier); tried in this order.
SALARY_PATTERNS = [
    (r"₹?(\d+(?:\.\d+)?)\s*-\s*₹?(\d+(?:\.\d+)?)\s*(?:lacs?|lpa|lakhs?)", True, 100000),
    (r"₹?(\d+(?:\.\d+)?)\s*(?:lacs?|lpa|lakhs?)", False, 100000),
    (r"₹\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*-\s*₹?\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)", True, 1),
    (r"₹\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)", False, 1),
    (r"\$(\d+(?:\.\d+)?)\s*k?\s*-\s*\$?(\d+(?:\.\d+)?)\s*k", True, 1000),
    (r"\$(\d+(?:\.\d+)?)\s*k", False, 1000),
    (r"\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*-\s*\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)", True, 1),
    (r"\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)", False, 1),
    (r"\$?(\d+(?:\.\d+)?)\s*-\s*\$?(\d+(?:\.\d+)?)\s*/?\s*(?:hr|hour)", True, 2080),
    (r"\$?(\d+(?:\.\d+)?)\s*/?\s*(?:hr|hour)", False, 2080),
    (r"(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)", True, 1),
    (r"(\d+(?:\.\d+)?)", False, 1),
]

SALARY_COLUMN_WORDS = ["salary", "compensation", "pay", "wage", "income"]

SALARY_CATEGORIES = [(300000, "Entry Level"), (600000, "Junior Level"),
                     (1200000, "Mid Level"), (2500000, "Senior Level")]
SALARY_CATEGORY_TOP = "Executive Level"

LAKH_BRACKETS = [(2, "Below 2 LPA"), (5, "2-5 LPA"), (10, "5-10 LPA"),
                 (20, "10-20 LPA"), (50, "20-50 LPA")]
LAKH_BRACKET_TOP = "50+ LPA"

# --- experience text -------------------------------------------------------
YEARS_RANGE = r"(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*(?:years?|yrs?|y)"
YEARS_PLUS = r"(\d+(?:\.\d+)?)\s*\+?\s*(?:years?|yrs?|y)"
EXECUTIVE_WORDS = r"(?:director|vp|vice president|head|chief|cxo)"
MONTHS_RANGE = r"(\d+)\s*-\s*(\d+)\s*(?:months?|mons?)"
MONTHS_PLUS = r"(\d+)\s*\+?\s*(?:months?|mons?)"
EXPERIENCE_LEVELS = [
    (r"(?:fresher|fresh graduate|0 years?|no experience)", 0.0, 0.0),
    (r"(?:entry level|junior|associate|trainee|intern)", 0.0, 2.0),
    (r"(?:mid level|middle|experienced|senior associate)", 3.0, 7.0),
    (r"(?:senior|lead|principal|manager|expert)", 8.0, 15.0),
]
TITLE_SENIOR_WORDS = ["senior", "sr", "lead", "principal", "manager", "head"]
TITLE_JUNIOR_WORDS = ["junior", "jr", "associate", "trainee", "intern", "entry"]
EXPERIENCE_BANDS = [(2, "Entry Level"), (5, "Junior Level"), (10, "Mid Level"), (15, "Senior Level")]

# --- posting classification ------------------------------------------------
REMOTE_WORDS = ["remote", "work from home", "wfh", "telecommute", "virtual", "distributed",
                "anywhere", "home-based", "online", "digital nomad"]
HYBRID_WORDS = ["hybrid", "flexible"]

JOB_CATEGORIES = {
    "Technology": ["software", "developer", "engineer", "programmer", "tech", "it",
                   "data scientist", "analyst", "web", "mobile", "devops", "cloud"],
    "Marketing": ["marketing", "digital marketing", "seo", "content", "social media",
                  "brand", "advertising", "campaign", "growth"],
    "Sales": ["sales", "business development", "account manager", "customer", "client",
              "revenue", "lead generation"],
    "Design": ["designer", "ui", "ux", "graphic", "creative", "visual", "art",
               "illustration", "branding"],
    "Finance": ["finance", "accounting", "financial", "analyst", "investment", "banking",
                "audit", "tax", "payroll"],
    "Human Resources": ["hr", "human resources", "recruiter", "talent", "people",
                        "organizational", "training", "employee"],
    "Operations": ["operations", "logistics", "supply chain", "project manager",
                   "coordinator", "administration", "office manager"],
    "Healthcare": ["doctor", "nurse", "medical", "healthcare", "physician", "therapist",
                   "pharmacist", "clinical"],
    "Education": ["teacher", "tutor", "education", "training", "instructor", "academic",
                  "curriculum", "learning"],
    "Customer Service": ["customer service", "support", "help desk", "call center",
                         "customer care", "service representative"],
}

SENIORITY_WORDS = {
    "Entry-Level": ["intern", "trainee", "junior", "associate", "entry", "graduate", "fresher"],
    "Mid-Level": ["analyst", "specialist", "coordinator", "executive"],
    "Senior-Level": ["senior", "lead", "principal", "expert", "consultant"],
    "Management": ["manager", "supervisor", "team lead", "head"],
    "Executive": ["director", "vp", "vice president", "ceo", "cto", "cfo", "chief"],
}
LEADERSHIP_LEVELS = ["Management", "Executive"]

METRO_CITIES = ["mumbai", "delhi", "bangalore", "hyderabad", "chennai", "kolkata"]
TIER1_CITIES = ["pune", "ahmedabad", "surat", "jaipur", "lucknow", "kanpur", "nagpur"]
TIER2_CITIES = ["coimbatore", "kochi", "indore", "bhopal", "visakhapatnam", "vadodara"]
COUNTRY_WORDS = ["india", "indian"]

FRIENDLY_WORDS = ["flexible", "work life balance", "maternity", "diversity", "inclusive",
                  "equal opportunity", "women", "female", "part time", "flexible hours"]
FLEXIBLE_WORDS = ["flexible schedule", "flexible timing", "work from home", "remote",
                  "part time", "freelance", "contract", "flexible hours"]
PART_TIME_WORDS = ["part time", "part-time", "freelance", "contract"]
SUITED_CATEGORIES = ["Education", "Healthcare", "Customer Service"]

SOURCE_LABELS = [("postings", "Job Postings"), ("glassdoor", "Glassdoor"),
                 ("salary", "Salary Data"), ("company", "Company Data"), ("eda", "EDA Dataset")]
PROCESSING_DATE = "2026-03-04"

# --- merging ---------------------------------------------------------------
MERGE_SYNONYMS = {
    "company_name": "company", "title": "job_title", "position": "job_title",
    "role": "job_title", "city": "location", "description": "job_description",
    "desc": "job_description",
}
PRIORITY_COLUMNS = [
    "job_title", "company", "company_name", "location", "job_description",
    "salary_min", "salary_max", "salary_avg", "salary_bracket",
    "required_experience_min", "required_experience_max", "experience_category",
    "remote_flag", "work_arrangement", "job_category", "seniority_level",
    "city_tier", "is_india", "female_friendly", "mother_suitability_score",
    "source_file", "data_source", "processing_date",
]

# --- master table ----------------------------------------------------------
MASTER_SCHEMA = [
    ("record_id", "bigint"), ("job_id", "string"), ("user_profile_id", "string"),
    ("job_title", "string"), ("company", "string"), ("location", "string"),
    ("job_description", "string"), ("job_category", "string"), ("job_subcategory", "string"),
    ("seniority_level", "string"),
    ("salary_min", "double"), ("salary_max", "double"), ("salary_avg", "double"),
    ("salary_bracket", "string"), ("currency", "string"), ("salary_type", "string"),
    ("required_experience_min", "double"), ("required_experience_max", "double"),
    ("experience_category", "string"),
    ("remote_flag", "boolean"), ("work_arrangement", "string"),
    ("flexible_hours", "boolean"), ("part_time_available", "boolean"),
    ("city_tier", "string"), ("is_india", "boolean"), ("is_metro", "boolean"),
    ("state", "string"), ("country", "string"),
    ("company_size", "string"), ("industry", "string"), ("company_rating", "double"),
    ("female_friendly", "boolean"), ("mother_suitability_score", "int"),
    ("childcare_support", "boolean"), ("career_growth_potential", "string"),
    ("skill_development_opportunities", "boolean"),
    ("required_skills", "string"), ("preferred_skills", "string"),
    ("education_requirement", "string"),
    ("source_type", "string"), ("data_source", "string"), ("processing_date", "string"),
    ("validation_score", "double"), ("is_synthetic", "boolean"), ("creation_method", "string"),
]

GENERATOR_TITLES = [
    "Software Developer", "Data Analyst", "Content Writer", "Digital Marketing Specialist",
    "Customer Service Representative", "Virtual Assistant", "Graphic Designer",
    "Social Media Manager", "Online Tutor", "Translator", "Accountant", "Nurse (Remote)",
    "HR Assistant", "Sales Executive", "Project Coordinator",
]
GENERATOR_CITIES = ["Mumbai", "Delhi", "Bangalore", "Hyderabad", "Chennai", "Kolkata",
                    "Pune", "Ahmedabad", "Jaipur", "Surat", "Lucknow", "Kanpur"]

GENERATED_CATEGORIES = [
    ("Technology", ["software", "developer", "data", "analyst"]),
    ("Marketing", ["marketing", "social media", "content"]),
    ("Customer Service", ["customer", "service", "support"]),
    ("Design", ["designer", "graphic"]),
    ("Human Resources", ["hr", "human resources"]),
    ("Sales", ["sales", "executive"]),
    ("Education", ["tutor", "teacher"]),
    ("Finance", ["accountant", "finance"]),
]
GENERATED_SENIORITY = [("Senior-Level", ["senior", "lead", "manager"]),
                       ("Entry-Level", ["assistant", "junior"])]
GENERATED_SALARY_BANDS = [(3, "Below 3 LPA"), (6, "3-6 LPA"), (10, "6-10 LPA"), (15, "10-15 LPA")]
GENERATED_EXPERIENCE_BANDS = [(1, "Fresher"), (3, "Entry Level"), (7, "Mid Level")]
GENERATED_TIERS = {
    "Tier-1": ["Mumbai", "Delhi", "Bangalore", "Hyderabad", "Chennai", "Kolkata"],
    "Tier-2": ["Pune", "Ahmedabad", "Jaipur", "Surat"],
}
CITY_STATES = {
    "Mumbai": "Maharashtra", "Delhi": "Delhi", "Bangalore": "Karnataka",
    "Hyderabad": "Telangana", "Chennai": "Tamil Nadu", "Kolkata": "West Bengal",
    "Pune": "Maharashtra", "Ahmedabad": "Gujarat", "Jaipur": "Rajasthan",
    "Surat": "Gujarat", "Lucknow": "Uttar Pradesh", "Kanpur": "Uttar Pradesh",
}
GENERATED_INDUSTRIES = [
    ("Information Technology", ["Software", "Data"]),
    ("Marketing & Advertising", ["Marketing"]),
    ("Design & Creative", ["Designer"]),
    ("Customer Service", ["Customer"]),
    ("Sales & Business Development", ["Sales"]),
]
TITLE_SKILLS = {
    "Software Developer": "Python, JavaScript, Problem Solving",
    "Data Analyst": "Excel, SQL, Data Visualization, Python",
    "Content Writer": "Writing, SEO, Research, Grammar",
    "Digital Marketing Specialist": "SEO, Google Ads, Social Media, Analytics",
    "Customer Service Representative": "Communication, Problem Solving, Patience",
    "Virtual Assistant": "Organization, Communication, MS Office",
    "Graphic Designer": "Photoshop, Illustrator, Creativity, Design Thinking",
    "Social Media Manager": "Social Media Marketing, Content Creation, Analytics",
    "Online Tutor": "Teaching, Subject Knowledge, Communication",
    "Translator": "Language Skills, Accuracy, Cultural Knowledge",
    "Accountant": "Accounting, Excel, Tally, GST Knowledge",
    "HR Assistant": "HR Processes, Communication, MS Office",
}
DEFAULT_TITLE_SKILLS = "Communication, Computer Skills, Problem Solving"

# --- imputation ------------------------------------------------------------
CRITICAL_COLUMNS = ["job_title", "company"]
IMPUTE_CRITICAL = ["job_title", "company", "company_name", "location", "job_category", "seniority_level"]
IMPUTE_MODE = ["job_category", "seniority_level", "work_arrangement", "city_tier",
               "salary_bracket", "experience_category"]
IMPUTE_DEFAULT = {"location": "Unknown Location", "source_file": "Unknown Source",
                  "data_source": "Mixed"}
IMPUTE_FALSE = ["remote_flag", "female_friendly", "flexible_hours", "part_time_available",
                "is_metro", "is_india", "leadership_role"]
IMPUTE_ZERO = ["views", "applies", "zip_code", "fips"]

# --- profiles --------------------------------------------------------------
EDUCATION_LEVELS = [
    "Below 8th/Informal Education", "8th Pass", "10th Pass (SSC)", "12th Pass (HSC)",
    "Diploma/ITI", "Graduate (BTech/BA/BCom/BSc)", "Post Graduate (MBA/MTech/MA/MSc)",
    "PhD/Doctorate",
]
EDUCATION_ORDINAL = {name: i for i, name in enumerate(EDUCATION_LEVELS)}
EDUCATION_INCOME = dict(zip(EDUCATION_LEVELS,
                            [15000, 20000, 25000, 30000, 40000, 55000, 80000, 120000]))
EDUCATION_POINTS = dict(zip(EDUCATION_LEVELS, [3, 5, 8, 10, 13, 17, 20, 20]))
EDUCATION_WORD_LEVELS = {
    "10th": 1, "12th": 2, "diploma": 3, "graduate": 4, "bachelor": 4,
    "postgraduate": 5, "master": 5, "mba": 5, "phd": 6, "doctorate": 6,
}
DOMAIN_INCOME = {
    "Medical Doctors": 180000, "Consulting": 140000, "Investment": 140000,
    "Data Science": 120000, "Legal": 110000, "Cybersecurity": 110000,
    "Software Engineering": 100000, "Cloud & DevOps": 100000, "Higher Education": 90000,
    "UI/UX Design": 80000, "Banking Operations": 70000, "Pharma Sales": 65000,
    "HR": 55000, "Marketing": 50000, "Content Writing": 45000, "Accounting": 50000,
    "Customer Support": 35000, "Data Entry": 30000, "Food Service": 28000,
    "Childcare": 25000, "Housekeeping": 22000,
}
DOMAIN_INCOME_DEFAULT = 40000
SENIORITY_MULTIPLIER = {
    "Entry Level/Fresher": 0.6, "Associate": 0.8, "Junior": 0.8, "Senior Associate": 1.0,
    "Manager": 1.3, "Senior Manager": 1.6, "Director/Executive": 2.0,
}
TIER_MULTIPLIER = {"Metro": 1.3, "Tier-1": 1.2, "Tier-2": 1.0, "Tier-3": 0.85, "Rural": 0.7}
INCOME_BRACKETS = [
    (0, 10000, "Below 10K"), (10000, 20000, "10K-20K"), (20000, 35000, "20K-35K"),
    (35000, 50000, "35K-50K"), (50000, 75000, "50K-75K"), (75000, 100000, "75K-1L"),
    (100000, 150000, "1L-1.5L"), (150000, 200000, "1.5L-2L"), (200000, None, "Above 2L"),
]
SIMPLE_SENIORITY = {
    "Entry Level/Fresher": "Entry", "Junior": "Entry", "Associate": "Mid",
    "Senior Associate": "Mid", "Manager": "Senior", "Senior Manager": "Senior",
    "Director/Executive": "Senior",
}
SENIORITY_STANDARD = {
    "entry": "Entry", "entry level": "Entry", "fresher": "Entry", "intern": "Entry",
    "junior": "Junior", "associate": "Junior", "mid": "Mid", "mid-level": "Mid",
    "intermediate": "Mid", "senior": "Senior", "sr": "Senior", "lead": "Lead",
    "team lead": "Lead", "principal": "Lead", "manager": "Manager", "mgr": "Manager",
    "director": "Director", "head": "Director", "vp": "VP", "vice president": "VP",
    "c-level": "CXO", "cxo": "CXO", "executive": "CXO",
}
SENIORITY_EXPERIENCE = {
    "Entry Level/Fresher": (0, 2), "Junior": (1, 5), "Senior Associate": (3, 10),
    "Manager": (5, 15), "Senior Manager": (8, 20), "Director/Executive": (10, 30),
}
SENIORITY_ORDINAL = {"Entry Level/Fresher": 0, "Associate": 1, "Senior Associate": 2,
                     "Manager": 3, "Senior Manager": 4, "Director/Executive": 5}
SENIORITY_SHORT_ORDINAL = {"Entry": 0, "Junior": 1, "Mid": 2, "Senior": 3, "Lead": 4, "Manager": 5}
SENIORITY_EXPECTED_SKILLS = {"Entry": 3, "Junior": 6, "Mid": 10, "Senior": 15, "Lead": 20, "Manager": 15}
SCORING_EXPECTED_SKILLS = {"Entry Level/Fresher": 3, "Associate": 6, "Senior Associate": 10,
                           "Manager": 15, "Senior Manager": 20, "Director/Executive": 15}
DOMAIN_KEYWORDS = {
    "Technology": ["python", "java", "software", "data", "cloud", "aws", "code"],
    "Healthcare": ["medical", "health", "patient", "clinical", "nurse", "care"],
    "Finance": ["accounting", "finance", "banking", "audit", "tax", "investment"],
    "Education": ["teaching", "curriculum", "training", "education", "learning"],
    "Marketing": ["marketing", "seo", "content", "social", "brand", "digital"],
    "Sales": ["sales", "crm", "negotiation", "client", "revenue", "target"],
    "HR": ["recruitment", "hr", "talent", "payroll", "employee", "hiring"],
    "Operations": ["operations", "logistics", "supply", "inventory", "process"],
}
DOMAIN_COMPLEXITY = {"Technology": 1.3, "Data Science": 1.4, "Finance": 1.2,
                     "Healthcare": 1.3, "Marketing": 1.1, "Education": 1.0}
REMOTE_MODES = ["Remote", "Work From Home", "Hybrid"]
TIER_ORDINAL = {"Metro": 4, "Tier-1": 3, "Tier-2": 2, "Tier-3": 1, "Rural": 0, "Remote": 3}
TIER_PROFILE_ORDINAL = {"Metro": 0, "Tier-1": 1, "Tier-2": 2, "Tier-3": 3, "Remote": 4, "Rural": 5}
GROWTH_ORDINAL = {"Low": 0, "Medium": 1, "High": 2}
GROWTH_POINTS = {"Low": 30, "Medium": 60, "High": 90}
TRAVEL_STRESS = {"No Travel": 0, "Occasional": 10, "Frequent": 20}
SCORING_TRAVEL_STRESS = {"No Travel": 0, "Occasional": 15, "Frequent": 30}
TRAVEL_FREEDOM = {"No Travel": 1.0, "Occasional": 0.5, "Frequent": 0.0}
MODE_SCORES = {"remote": 100, "hybrid": 75, "office": 50, "onsite": 40}
SCORING_MODE_SCORES = {"Work From Home": 100, "Remote": 100, "Hybrid": 75, "Office": 50,
                       "On-site": 40, "Field Work": 30}
SUITABILITY_CLASSES = ["Not_Suitable", "Low", "Moderate", "Good", "Excellent"]
BALANCE_CLASSES = ["Poor", "Below_Average", "Average", "Good", "Excellent"]
QUINTILE_INCOME_CLASSES = ["Very_Low", "Low", "Medium", "High", "Very_High"]

PROFILE_WEIGHTS = {
    "age": 10, "education": 15, "experience_years": 12, "primary_skill": 15,
    "all_skills": 10, "domain": 10, "city": 5, "marital_status": 3, "hours_available": 5,
    "work_mode": 5, "secondary_skill": 3, "language": 2, "device": 2, "kids": 3,
}
FORM_WEIGHTS = {
    "age": 8, "education": 12, "experience_years": 10, "primary_skill": 12, "all_skills": 8,
    "domain": 10, "city": 5, "marital_status": 3, "hours_available": 5, "work_mode": 5,
    "secondary_skill": 5, "language": 3, "device": 2, "kids": 2, "sector": 5, "shift_type": 5,
}
EMPTY_TEXTS = ["", "nan", "None", "null", "Unknown"]
ADVICE_PRIORITY = ["primary_skill", "education", "experience_years", "domain", "all_skills"]

# --- skills and careers ----------------------------------------------------
DOMAIN_SKILLS = {
    "Technology": ["python", "java", "sql", "cloud", "api", "aws", "docker", "kubernetes"],
    "Data Science": ["python", "machine learning", "statistics", "sql", "tensorflow", "pandas"],
    "Design": ["figma", "photoshop", "ui/ux", "illustrator", "sketch", "prototyping"],
    "Marketing": ["seo", "google ads", "social media", "content writing", "analytics"],
    "Finance": ["excel", "financial modeling", "accounting", "taxation", "tally"],
    "Healthcare": ["patient care", "medical records", "hipaa", "clinical research"],
    "Education": ["curriculum development", "teaching", "assessment", "edtech"],
    "HR": ["recruitment", "employee relations", "hris", "payroll", "training"],
    "Sales": ["crm", "negotiation", "lead generation", "closing", "salesforce"],
    "Operations": ["process optimization", "supply chain", "quality control", "lean"],
}
PREREQUISITES = {
    "machine learning": ["python", "statistics", "linear algebra"],
    "deep learning": ["machine learning", "python", "calculus"],
    "kubernetes": ["docker", "linux", "networking"],
    "microservices": ["api", "docker", "cloud"],
    "data engineering": ["sql", "python", "etl"],
    "cloud architecture": ["cloud", "networking", "security"],
    "devops": ["linux", "git", "ci/cd"],
    "full stack": ["frontend", "backend", "database"],
}
GAP_ADVICE = [
    (20, ["Your skills are well-aligned with domain requirements",
          "Consider advanced certifications to stand out",
          "Focus on soft skills development"]),
    (40, ["Minor skill gaps detected",
          "Consider online courses in missing areas",
          "Practice projects can help bridge the gap"]),
    (60, ["Moderate skill gaps detected",
          "Structured learning recommended",
          "Consider bootcamps or certification programs",
          "Target 2-3 key skills first"]),
    (None, ["Significant skill gaps detected",
            "Comprehensive training recommended",
            "Start with foundational skills",
            "Consider career coaching",
            "Set 6-month learning goals"]),
]
PROGRESSION = {
    "Entry": ("Junior", 1, 3), "Junior": ("Mid", 2, 5), "Mid": ("Senior", 3, 8),
    "Senior": ("Lead", 3, 10), "Lead": ("Manager", 2, 12), "Manager": ("Director", 4, 15),
    "Director": ("VP", 5, 18), "VP": ("CXO", 5, 20),
}
CAREER_PATHS = {
    "Technology": [
        "Developer -> Senior Developer -> Tech Lead -> Architect -> CTO",
        "Developer -> DevOps -> Platform Engineer -> Infrastructure Director"],
    "Data Science": [
        "Data Analyst -> Data Scientist -> Senior DS -> Lead DS -> Head of Data",
        "ML Engineer -> Senior ML Engineer -> ML Architect -> Chief AI Officer"],
    "Design": [
        "UI Designer -> Senior Designer -> Design Lead -> Design Director -> CDO",
        "UX Researcher -> Senior UX -> UX Manager -> VP of Design"],
    "Marketing": [
        "Marketing Executive -> Manager -> Director -> CMO",
        "Content Writer -> Content Lead -> Content Director -> VP Marketing"],
    "Finance": [
        "Analyst -> Senior Analyst -> Manager -> Director -> CFO",
        "Accountant -> Senior Accountant -> Controller -> Finance Director"],
}
SUITABILITY_ADVICE = {
    "Excellent": ["This job is highly suitable for working mothers",
                  "Great flexibility and family-friendly benefits", "Apply with confidence!"],
    "Good": ["This job offers good work-life balance",
             "Consider negotiating for more flexibility if needed",
             "A solid choice for working mothers"],
    "Moderate": ["This job has some mother-friendly features",
                 "Discuss childcare options during interview", "May require some adjustments"],
    "Low": ["Limited flexibility for working mothers", "Consider your support system carefully",
            "Negotiate for remote/flexible options"],
    "Not_Suitable": ["This job may be challenging for mothers with young children",
                     "Consider alternatives with better flexibility",
                     "May work better once children are older"],
}
BALANCE_ADVICE = {
    "Excellent": ["Great work-life balance!", "This role supports your lifestyle needs",
                  "Take advantage of flexibility offered"],
    "Good": ["Solid balance for most people", "Discuss additional flexibility if needed",
             "Establish boundaries early"],
    "Average": ["Balance is manageable but needs effort", "Negotiate for flexible arrangements",
                "Plan your time carefully"],
    "Below_Average": ["May be challenging for parents", "Consider negotiating better terms",
                      "Evaluate your support system"],
    "Poor": ["Significant impact on personal life expected", "Consider if role is right fit",
             "Discuss concerns before accepting"],
}
SUGGESTED_SKILLS = {
    "Software Engineering": ["Python", "JavaScript", "React", "SQL", "Git"],
    "Data Science": ["Python", "Machine Learning", "SQL", "Tableau", "Statistics"],
    "Digital Marketing": ["SEO", "Google Ads", "Social Media", "Content Writing", "Analytics"],
    "Graphic Design": ["Photoshop", "Illustrator", "Figma", "Canva", "Typography"],
    "Content Writing": ["SEO Writing", "Copywriting", "Blogging", "Social Media", "Editing"],
    "Data Entry": ["Excel", "Typing Speed", "Google Sheets", "MS Office", "Accuracy"],
    "Customer Support": ["Communication", "CRM Tools", "Email Writing", "Problem Solving", "Patience"],
    "School Teaching": ["Lesson Planning", "EdTech Tools", "Communication", "Subject Expertise", "Patience"],
    "Beauty Wellness": ["Skin Care", "Hair Styling", "Makeup", "Nail Art", "Client Management"],
    "Handicrafts": ["Product Photography", "Online Selling", "Packaging", "Design", "Marketing"],
    "Ecommerce": ["Product Listing", "Inventory", "Customer Service", "Marketing", "Analytics"],
    "Nursing": ["Patient Care", "Medical Records", "First Aid", "Communication", "Empathy"],
}
SUGGESTED_SKILLS_DEFAULT = ["Communication", "Time Management", "Computer Basics",
                            "Online Collaboration", "Self-Marketing"]
SECTOR_DOMAINS = {
    "IT & Technology": ["Software Engineering", "Web Development", "Mobile App Dev", "Cloud & DevOps", "Cybersecurity", "Data Science", "AI & Machine Learning", "QA Testing", "IT Support", "Systems Administration", "Database Management"],
    "Healthcare & Medical": ["Nursing", "Medical Doctors", "Allied Health", "Mental Health", "Pharma Sales", "Medical Coding", "Health Administration", "Physiotherapy", "Lab Technician"],
    "Education & E-Learning": ["School Teaching", "Higher Education", "EdTech", "Tutoring", "Corporate Training", "Special Education", "Curriculum Development", "Language Training"],
    "Banking & Finance": ["Accounting", "Financial Analysis", "Banking Operations", "Insurance", "Investment", "Tax Consulting", "Wealth Management", "Risk Management", "Fintech", "Bookkeeping"],
    "Marketing & Sales": ["Sales", "Marketing", "Digital Marketing", "SEO & SEM", "Social Media Marketing", "PR & Communications", "Brand Management", "Market Research", "Advertising"],
    "E-Commerce & Retail": ["Ecommerce", "Retail", "Digital Store Mgmt", "Cataloging", "Inventory Mgmt", "Supply Chain", "Merchandising", "Dropshipping"],
    "Content & Media": ["Content Writing", "Copywriting", "Journalism", "Editing", "Video Production", "Graphic Design", "Animation & VFX", "Blogging"],
    "Customer Service": ["Customer Support", "BPO & Call Center", "Technical Support", "CRM Management", "Virtual Assistant", "Data Entry", "Order Processing"],
    "Beauty & Wellness": ["Beauty Wellness", "Makeup & Styling", "Skincare", "Yoga & Meditation", "Personal Training", "Nutrition & Dietetics", "Spa & Therapy"],
    "Caregiving & Homecare": ["Childcare", "Elderly Care", "Babysitting", "Caregiving", "Special Needs Care", "Home Management", "Nursing at Home"],
    "Creative Arts & Design": ["Fashion Design", "Interior Design", "Handicrafts", "Jewellery Design", "UI/UX Design", "Photography", "Illustration", "Tailoring"],
    "Administration & HR": ["Administration", "HR", "Recruitment", "Payroll & Benefits", "Office Management", "Executive Assistant", "Training & Development", "Legal Secretary"],
    "Agriculture & Dairy": ["Agriculture", "Dairy Animal", "Poultry Farming", "Organic Farming", "Agri-Business", "Agri-Tech", "Horticulture", "Veterinary Services"],
    "Hospitality & Tourism": ["Hotel Management", "Food Service", "Travel Tourism", "Event Management", "Front Office", "Tour Guiding", "Flight Attendant"],
    "Manufacturing & Logistics": ["Manufacturing", "Quality Control", "Production Planning", "Warehouse Mgmt", "Supply Chain Co-ordination", "Safety Management"],
    "Legal & Compliance": ["Legal", "Paralegal", "Corporate Law", "Litigation", "Intellectual Property", "Compliance", "Notary Services"],
    "Gig Economy & Freelance": ["Freelancing", "Micro-tasks", "Delivery Logistics", "Ride Sharing", "Home Services"],
    "Real Estate & Property": ["Real Estate", "Property Management", "Real Estate Sales", "Construction", "Architecture"],
    "Social Work & NGO": ["Social Work", "NGO Mgmt", "Fundraising", "Community Development", "Counseling"],
    "Government Services": ["Government", "Public Safety", "Municipal Services", "Policy Research", "Infrastructure"],
    "Data & Analytics": ["Data Analytics", "Big Data", "Business Intelligence", "Statistical Analysis"],
    "Science & Research": ["Research & Development", "Biotechnology", "Environmental Science"],
    "Telecommunications": ["Network Engineering", "Telecom Operations", "Broadband Services"],
    "Energy & Environment": ["Renewable Energy", "Waste Management", "Sustainability Consulting"],
    "General": ["General"],
}
DOMAIN_TRAINING_SKILLS = {
    "Software Engineering": ["Python", "Java", "JavaScript", "React", "Node.js", "SQL", "Git"],
    "Data Entry": ["Excel", "Typing", "Data Management", "Microsoft Office", "Google Sheets"],
    "Content Writing": ["Copywriting", "SEO", "Editing", "Creative Writing", "Blogging", "Grammar"],
    "Digital Marketing": ["SEO", "SEM", "Social Media Marketing", "Email Marketing", "Google Analytics", "Content Strategy"],
    "Nursing": ["Patient Care", "First Aid", "CPR", "Medical Records", "Patient Monitoring"],
    "School Teaching": ["Lesson Planning", "Classroom Management", "Communication", "Subject Expertise", "Child Psychology"],
    "Graphic Design": ["Photoshop", "Illustrator", "Canva", "Logo Design", "Typography", "Color Theory"],
    "Beauty Wellness": ["Makeup", "Skincare", "Hair Styling", "Yoga", "Personal Grooming"],
    "Accounting": ["Tally", "QuickBooks", "GST", "Income Tax", "Auditing", "Bookkeeping"],
    "Customer Support": ["Communication", "Problem Solving", "CRM", "Email Handling", "Active Listening"],
    "Tailoring": ["Stitching", "Cutting", "Embroidery", "Fashion Design", "Fabric Knowledge"],
    "Baking": ["Oven Handling", "Decoration", "Recipe Following", "Food Safety"],
    "Cooking": ["Vegetarian", "Non-Vegetarian", "Desserts", "Kitchen Management"],
    "General": ["Communication", "Time Management", "Basic Computer", "English Speaking"],
}
LABEL_LEVELS = {"Entry": "Entry Level", "Mid": "Mid Level", "Senior": "Senior Level"}

# --- allowed states --------------------------------------------------------
APPLICATION_STATES = ["Pending", "Reviewed", "Shortlisted", "Rejected"]
CALL_STATES = ["Pending", "Called", "Cancelled"]
ORGANISATION_STATES = ["Approved", "Declined"]

# --- text ------------------------------------------------------------------
# Default stop list of the text vectoriser; a parameter there.
# The default English stop words that Spark ships.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its",
    "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom",
    "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll",
    "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd",
    "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've",
    "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't",
    "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't",
    "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's",
    "what's", "when's", "where's", "who's", "why's", "would",
]
