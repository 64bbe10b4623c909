"""Schemas of the library's tables, as DDL."""

FILINGS = "accession_number string, cik string, ticker string, company_name string, form_type string, filed_date date, fiscal_year_end date, url string"
SECTIONS = "filing_id string, section_name string, raw_text string, word_count int, extracted_at timestamp"
LEXICON = "word string, category string"
SENTIMENT = "filing_id string, section_name string, analyzer_name string, sentiment_score double, confidence double, metadata string, analyzed_at timestamp"
SIMILARITY = "filing_id string, prior_filing_id string, section_name string, similarity_score double, change_score double, analyzed_at timestamp"
SIGNALS = "ticker string, signal_date date, signal_name string, raw_value double, z_score double, percentile double, decay_weight double"
COMPOSITES = "ticker string, signal_date date, composite_score double, components map<string,double>, rank int"
PRICES = "ticker string, date date, open double, high double, low double, close double, volume bigint, adj_close double, source string"
UNIVERSE = "ticker string, start_date date, end_date date"

# Names that stored rows may hold.
FORM_TYPES = ("10-K", "10-Q", "10-K/A", "10-Q/A")
SECTION_NAMES = ("mda", "risk_factors", "business", "financial")
CATEGORIES = ("negative", "positive", "uncertainty", "litigious", "constraining", "strong_modal", "weak_modal")
