"""Where documents come from and go to: tables, files, stored collections and the change log."""
