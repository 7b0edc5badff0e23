"""The analytical operators: statistics, calendars, rules, policies and costs."""
