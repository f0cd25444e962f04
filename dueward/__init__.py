"""Governance of service-request data as DataFrame-to-DataFrame operators."""
