"""Row order and the filter language: what turns requests into logical plans."""
