"""Tables: reading, writing, row numbers, keywords and managed storage."""
