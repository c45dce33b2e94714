"""attestry: evidence and policy analytics over file, rule and report tables on Spark."""
