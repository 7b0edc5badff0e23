"""Writers: idempotent bar storage, calendars, journals and series."""
