"""Where data comes from and goes to: tables in the shared folder, field policies, CRM connectors."""
