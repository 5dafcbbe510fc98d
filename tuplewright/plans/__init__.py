"""Programs as data: syntax, analysis and stratification, all on the driver."""
